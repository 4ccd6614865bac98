"""Comparison of rows that share a signature, by sizes, places and parity bits, in machine words.

Rows of a signature stand in order of size. A row is compared with those of a stretch only: no smaller than it, and no
larger than its place in its own prefix allows. A word of parity bits of many pairs is compared at a time, so a signature
that very many rows share costs about two nanoseconds a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a row's number that hold its size, its place and its side; the rest is the signature. The largest size stands
#: for all from it on, for which size and place reject nothing.
SIZE, PLACE, SIDE = 12, 11, 1
META = SIZE + PLACE + SIDE
LARGEST, FARTHEST = (1 << SIZE) - 1, (1 << PLACE) - 1
#: Rows that are collected before they are compared, stretches up to this are compared pair by pair, pairs at a time of
#: the latter, and rows and columns of a tile of the former.
ROWS, SHORT, AT_ONCE, TILE = 100_000, 96, 1 << 18, (64, 512)
NAMES = ["sig", "no", "bits_a", "bits_b", "bits_c"]
SCHEMA = "sig bigint, no bigint, bits_a bigint, bits_b bigint, bits_c bigint"


def pack(sig: np.ndarray, size: np.ndarray, place: np.ndarray | int, side: int) -> np.ndarray:
    """Signature, size, place and side as one number whose order is that of these in turn, within a signature."""
    low = np.minimum(size, LARGEST) << (PLACE + SIDE) | np.minimum(place, FARTHEST) << SIDE | side
    return (sig.astype(np.uint64) & ~np.uint64((1 << META) - 1) | low.astype(np.uint64)).view(np.int64)


def close(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all rows i of a and j of b, lo[i] <= j < hi[i], with no more different bits than elements may differ.

    a and b are of three rows of words, unsigned, as bitwise_count sees no sign; the stretches of neighbours lie near each
    other. Two words of a tile rule nearly all pairs out, the third is compared for the rest.
    """
    at = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def keep(i: np.ndarray, j: np.ndarray, differ: np.ndarray) -> None:
        ok = np.flatnonzero((differ.astype(np.int64) * (100 + t) <= (size_a[i] + size_b[j]) * (100 - t)) & (lo[i] <= j) & (j < hi[i]))
        at.append((i[ok], j[ok]))

    count = np.maximum(hi - lo, 0)
    few = np.flatnonzero((count > 0) & (count <= SHORT))
    ends = np.cumsum(count[few])
    start = 0
    while start < len(few):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
        rows = few[start:stop]
        i = np.repeat(rows, count[rows])
        j = np.arange(len(i)) + np.repeat(lo[rows] - (np.cumsum(count[rows]) - count[rows]), count[rows])
        keep(i, j, sum(np.bitwise_count(a[w][i] ^ b[w][j]) for w in range(3)))
        start = stop
    many = np.flatnonzero(count > SHORT)
    high, wide = TILE
    words, bits, differ, hit = np.empty(high * wide, np.uint64), np.empty(high * wide, np.uint8), np.empty(high * wide, np.uint8), np.empty(high * wide, bool)
    start = 0
    while start < len(many):
        rows = many[start : start + high]
        apart = np.flatnonzero(lo[rows[1:]] >= hi[rows[:-1]])  # the stretches of another signature
        rows = rows[: apart[0] + 1] if len(apart) else rows
        start += len(rows)
        first, last = int(lo[rows].min()), int(hi[rows].max())
        most = int(size_a[rows].max())
        left = a[:, rows, None]
        for c in range(first, last, wide):
            e = min(c + wide, last)
            shape = (len(rows), e - c)
            w, n, d, h = (x[: shape[0] * shape[1]].reshape(shape) for x in (words, bits, differ, hit))
            np.bitwise_count(np.bitwise_xor(left[0], b[0, c:e], out=w), out=d)
            np.add(d, np.bitwise_count(np.bitwise_xor(left[1], b[1, c:e], out=w), out=n), out=d)
            np.less_equal(d, min((most + int(size_b[c:e].max())) * (100 - t) // (100 + t), 192), out=h)
            some = np.flatnonzero(h)
            if len(some):
                i, j = rows[some // shape[1]], c + some % shape[1]
                keep(i, j, d.ravel()[some] + np.bitwise_count(a[2, i] ^ b[2, j]))
    i, j = (np.concatenate(x) for x in zip(*at))
    return i, j


def compare(packed: np.ndarray, no: np.ndarray, bits: np.ndarray, t: int, across: bool) -> np.ndarray:
    """Numbers of the rows of each close pair, a row each, of rows in the order of packed. Across: the first is of side 0,
    the other of side 1; else sides don't matter and the first number is the smaller."""
    bits, size = bits.view(np.uint64), packed >> (PLACE + SIDE) & LARGEST
    place = packed >> SIDE & FARTHEST
    sig = packed >> META
    key = np.cumsum(np.r_[False, sig[1:] != sig[:-1]]) * (LARGEST + 1) + size
    most = np.minimum((size - place) * (100 + t) // t - size, LARGEST)
    most = np.where(size == LARGEST, LARGEST, most)
    end = key - size + np.maximum(most, 0)
    if not across:
        lo = np.arange(1, len(key) + 1)
        hi = np.where(most >= size, np.searchsorted(key, end, "right"), lo)
        i, j = close(bits, bits, size, size, lo, hi, t)
        return np.unique(np.sort(np.stack([no[i], no[j]], 1), 1), axis=0)
    out = []
    sides = [np.flatnonzero((packed & 1) == s) for s in (0, 1)]
    for s, side in ((0, "left"), (1, "right")):  # of equal sizes, the row of side 0 counts as the smaller
        x, y = sides[s], sides[1 - s]
        lo = np.searchsorted(key[y], key[x], side)
        hi = np.where(most[x] >= size[x], np.searchsorted(key[y], end[x], "right"), lo)
        i, j = close(bits[:, x], bits[:, y], size[x], size[y], lo, hi, t)
        pair = np.stack([no[x[i]], no[y[j]]], 1)
        out.append(pair[:, ::-1] if s else pair)
    pairs = np.concatenate(out)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def close_pairs(rows: DataFrame, threshold: float, across: bool = False) -> DataFrame:
    """(low_no, high_no), or (left_no, right_no) across sides: different pairs of rows (sig, no, bits..) of one signature
    that sizes, places and parity bits don't rule out. All pairs over the threshold that have a signature in common with
    places that allow it are among them.

    The rows are shuffled once. A task holds the rows of one signature, or ROWS of several.
    """
    t = int(round(threshold * 100))
    names = ["left_no", "right_no"] if across else ["low_no", "high_no"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            columns = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(5)]
            sig = columns[0] >> META
            stop = len(sig) if whole else int(np.searchsorted(sig, sig[-1], "left"))  # the last signature may go on
            use = np.zeros(stop, bool)
            same = sig[1:stop] == sig[: max(stop - 1, 0)]
            use[1:] |= same
            use[:-1] |= same
            use = np.flatnonzero(use)
            if len(use):
                pairs = compare(columns[0][use], columns[1][use], np.stack([c[use] for c in columns[2:]]), t, across)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names)
            rest = [pa.array(c[stop:]) for c in columns]
            held, count = [pa.RecordBatch.from_arrays(rest, NAMES)], len(rest[0])

        limit = ROWS
        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count >= limit:
                yield from flush(False)
                limit = max(ROWS, 2 * count)  # of a signature with more rows, not all are looked at again for every batch
        if count:
            yield from flush(True)

    rows = rows.select(*NAMES).repartition(F.shiftright("sig", META)).sortWithinPartitions("sig")
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names)).distinct()
