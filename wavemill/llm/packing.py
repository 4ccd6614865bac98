"""Problem 1: filling fixed-capacity sequences with texts of varying length along a space-filling curve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import FILE, TOKENIZER_DIR, encoder
from .common import cut, first_per_key, spread

#: Dimensions of a document's hashed word vector, of its projection, and bits of each projected coordinate.
BUCKETS, DIMS, BITS = 1024, 4, 8
#: Neighbours on the curve that are placed together, longest first, and how many items further along the curve a sequence
#: stays open after its first.
WINDOW, REACH = 512, 1024
SLICE = 1024


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows) with coordinates under 2 ** bits; Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _measure(batches: Iterator[pa.RecordBatch], folder: str, file: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Length in code points and tokens, and curve key, of each text of column 2; columns 0 and 1 are passed on."""
    bpe = encoder(folder, file)
    plane = np.random.default_rng(7).choice(np.array([-1.0, 1.0]), (BUCKETS, DIMS))
    seen: dict[str, tuple[int, int]] = {}
    for big in batches:
        for at in range(0, big.num_rows, SLICE):
            batch = big.slice(at, SLICE)
            texts = batch.column(2).to_pylist()
            parts = bpe.split_all(texts)
            if len(seen) > 500_000:
                seen.clear()
            for w in {w for p in parts for w in p} - seen.keys():
                seen[w] = (len(bpe.known[w]), xxhash.xxh32_intdigest(w.strip().lower().encode("utf-8", "surrogatepass")) % BUCKETS)
            pairs = np.array([seen[w] for p in parts for w in p], np.int64).reshape(-1, 2)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            n = len(parts)
            tokens = np.bincount(owner, pairs[:, 0], n).astype(np.int64)
            cell = np.unique(owner * BUCKETS + pairs[:, 1])
            doc, bucket = cell // BUCKETS, cell % BUCKETS
            norm = np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
            z = np.stack([np.bincount(doc, plane[bucket, k], n) / norm for k in range(DIMS)], 1)
            grid = np.clip((1 / (1 + np.exp(-1.702 * z))) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            key = hilbert(grid, BITS)
            chars = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chars), pa.array(tokens), pa.array(key)], names)


def qa_items(qa: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, file: str = FILE) -> DataFrame:
    """(item_id, chars, tokens, curve_key): one row per record, text = thinking, line feed, answer.

    A null part counts as empty. Of a record delivered several times the last delivery counts. Texts are measured
    where they are read; only the four numbers are shuffled.
    """
    text = F.concat(F.coalesce("thinking", F.lit("")), F.lit("\n"), F.coalesce("answer", F.lit("")))
    names = ["item_id", "loaded_at", "chars", "tokens", "curve_key"]
    rows = spread(qa.select(F.col("qa_id").alias("item_id"), "loaded_at", text.alias("text")), "item_id", "loaded_at").mapInArrow(
        lambda b: _measure(b, tokenizer_dir, file, names), "item_id bigint, loaded_at timestamp, chars bigint, tokens bigint, curve_key bigint"
    )
    return first_per_key(rows, ["item_id"], ["chars", "tokens", "curve_key"], "loaded_at")


class Filler:
    """Best fit over open containers of one capacity. Free room is found with a bit mask of the room sizes on offer.

    A container closes once the front, the place on the curve of what is filled in, is further than reach from its first
    item; closed ones are found out and dropped when they are offered.
    """

    def __init__(self, capacity: int, base: int, reach: int = REACH):
        self.capacity, self.base, self.reach, self.count, self.front = capacity, base, reach, 0, 0
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.mask = 0

    def place(self, length: int) -> tuple[int, int]:
        """Container and offset of a piece no longer than the capacity."""
        fit, room, box, born = self.mask >> length, self.capacity, -1, self.front
        while fit:
            room = length + (fit & -fit).bit_length() - 1
            stack = self.open[room]
            box, born = stack.pop()
            if not stack:
                self.mask &= ~(1 << room)
                del self.open[room]
            if self.front - born <= self.reach:
                break
            fit, room, box, born = self.mask >> length, self.capacity, -1, self.front
        if box < 0:
            box = self.base + self.count
            self.count += 1
        left = room - length
        if left:
            self.open.setdefault(left, []).append((box, born))
            self.mask |= 1 << left
        return box, self.capacity - room


OUT = "limit_id int, sequence_id bigint, item_id bigint, piece int, item_start bigint, length bigint, sequence_offset bigint"


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fills sequences with items (limit_id, capacity, item_id, length) that come in the order of the curve."""
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 36
    fillers: dict[int, Filler] = {}
    names = [c.split()[0] for c in OUT.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def window(limit: np.ndarray, capacity: np.ndarray, item: np.ndarray, length: np.ndarray) -> Iterator[tuple]:
        nonlocal base
        for one in np.unique(limit).tolist():
            of = np.flatnonzero(limit == one)
            cap = int(capacity[of[0]])
            filler = fillers.get(one)
            if filler is None:
                filler = fillers[one] = Filler(cap, base)
                base += 1 << 32
            full, rest = length[of] // cap, length[of] % cap
            for i, k in zip(of[full > 0].tolist(), full[full > 0].tolist()):  # only what exceeds the capacity is cut
                yield from ((one, *filler.place(cap), int(item[i]), p, p * cap, cap) for p in range(k))
            for j in np.argsort(-rest, kind="stable").tolist():
                if r := int(rest[j]):
                    k = int(full[j])
                    yield (one, *filler.place(r), int(item[of[j]]), k, k * cap, r)
            filler.front += len(of)

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        held.append(tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(4)))
        if sum(len(h[0]) for h in held) >= WINDOW:
            columns = [np.concatenate(x) for x in zip(*held)]
            whole = len(columns[0]) // WINDOW * WINDOW
            for at in range(0, whole, WINDOW):
                yield from _pieces(list(window(*(c[at : at + WINDOW] for c in columns))), names, types)
            held = [tuple(c[whole:] for c in columns)]
    if held:
        yield from _pieces(list(window(*(np.concatenate(x) for x in zip(*held)))), names, types)


def _pieces(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    if rows:
        limit, box, offset, item, piece, start, size = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((limit, box, item, piece, start, size, offset), types)], names)


def pack(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Places every item (item_id, chars, tokens, curve_key) in sequences of each limit (limit_id, unit, capacity).

    One row per piece: limit, sequence, item, number of the piece, its start in the item, its length, its place in
    the sequence. An item is cut only if longer than the capacity, into full pieces and one rest. Items are range-sorted
    by curve key, so a task holds one stretch of the curve and fills its own sequences from neighbours: best fit, the
    longest of a window of WINDOW items first. A sequence closes REACH items behind the front, so that what shares one
    lies close on the curve; each task ends with few that are partly filled. Limits with a null or non-positive capacity or an unknown unit take nothing; items of null length
    are none, of length 0 need no room and get no row. Equal lengths and keys are ordered by id.
    """
    spark = items.sparkSession
    lim = limits.filter("capacity > 0 and unit in ('chars', 'tokens')").select("limit_id", "unit", "capacity").distinct()
    rows = _spread(items, lim)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, "limit_id", "curve_key", "item_id").sortWithinPartitions("limit_id", "curve_key", "item_id")
    return sorted_rows.select("limit_id", "capacity", "item_id", "length").mapInArrow(_fill, OUT)


def _spread(items: DataFrame, lim: DataFrame) -> DataFrame:
    """Each item once for each limit; limits are settings, read on the driver like any other parameter."""
    settings = [(r.limit_id, r.unit, r.capacity) for r in lim.orderBy("limit_id").collect()]
    if not settings:
        return items.select(F.lit(0).alias("limit_id"), F.lit(1).cast("bigint").alias("capacity"), "curve_key", "item_id", F.col("tokens").alias("length")).limit(0)
    each = F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("bigint").alias("capacity"), F.col(u).cast("bigint").alias("length")) for i, u, c in settings])
    return items.select("item_id", "curve_key", F.explode(each).alias("x")).select("x.limit_id", "x.capacity", "curve_key", "item_id", "x.length").filter("length > 0")


def fill_report(placed: DataFrame, limits: DataFrame) -> DataFrame:
    """Sequences, filled room and share of each limit, and how many items were cut."""
    per = placed.groupBy("limit_id").agg(
        F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("used"), F.count_if(F.col("piece") == 1).alias("items_cut"), F.countDistinct("item_id").alias("items")
    )
    lim = limits.select(F.col("limit_id").alias("limit_id"), "unit", "capacity")
    return lim.join(per, "limit_id").select("limit_id", "unit", "capacity", "items", "items_cut", "sequences", "used", F.round(F.col("used") / (F.col("sequences") * F.col("capacity")), 6).alias("fill_share"))


def pack_qa(qa: DataFrame, limits: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """Measures and packs all records. The measures are written once: the range sort reads its input twice."""
    return pack(cut(qa_items(qa, tokenizer_dir)), limits)
