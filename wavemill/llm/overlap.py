"""Problem 4: same or almost same records across splits, by winnowing fingerprints, chained seeds and alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, first_per_key, mix64, not_blank, spread, words
from .compare import NAMES, SCHEMA, close_pairs, pack
from .near import THRESHOLD, candidates_across, elements

#: Words of a fingerprint, and fingerprints of a window: every common run of GRAM + WINDOW - 1 words shares one.
GRAM, WINDOW = 4, 6
#: Counters of fingerprints: a table of fixed size, whatever the corpus.
COUNTERS = 1 << 17
TRAIN, HELD_OUT = "train", ["valid", "test"]
SLICE = 2048


class Sequences:
    """Turns texts into sequences of word codes, by one dictionary for each task."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def of(self, texts: list[str]) -> list[np.ndarray]:
        parts = [words(t) for t in texts]
        if len(self.seen) > 500_000:
            self.seen.clear()
        for w in {w for p in parts for w in p} - self.seen.keys():
            self.seen[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))
        flat = np.fromiter((self.seen[w] for p in parts for w in p), np.uint32).view(np.int32)
        return np.split(flat, np.cumsum([len(p) for p in parts])[:-1])


def grams(seqs: list[np.ndarray], k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all runs of k words and the text of each; a shorter text is one run."""
    n = np.array([len(s) for s in seqs], np.int64)
    flat = np.concatenate(seqs).view(np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(seqs)), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    h = np.zeros(len(flat), np.uint64)
    left = n[owner] - place
    for i in range(k):
        inside = left > i
        h[inside] = mix64(h[inside] * np.uint64(0x2545F4914F6CDD1D) + flat[np.flatnonzero(inside) + i] + np.uint64(1))
    keep = (left >= k) | ((n[owner] < k) & (place == 0))
    return h[keep], owner[keep]


def winnow(h: np.ndarray, owner: np.ndarray, order: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least fingerprint of every window, by (order, hash); a text shorter than a window has one."""
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, order))] = np.arange(len(h))
    n = np.bincount(owner)[owner]
    place = np.arange(len(h)) - np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])[np.cumsum(np.r_[0, (owner[1:] != owner[:-1])])]
    best = np.arange(len(h))
    for i in range(1, window):
        at = np.minimum(np.arange(len(h)) + i, len(h) - 1)
        ok = (place + i < n) & (rank[at] < rank[best])
        best = np.where(ok, at, best)
    starts = (place + window <= n) | (place == 0)
    return np.unique(best[starts])


def parity(seqs: list[np.ndarray]) -> np.ndarray:
    """192 parity bits of each text's bag: bags that differ in d elements differ in at most d bits."""
    n = np.array([len(s) for s in seqs], np.int64)
    flat, owner = np.concatenate(seqs).view(np.uint32).astype(np.uint64), np.repeat(np.arange(len(seqs)), n)
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    at = np.arange(len(flat))
    start = np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]
    nth = (at - np.maximum.accumulate(np.where(start, at, 0))).astype(np.uint64)
    bit = (mix64(flat + nth * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(192)).astype(np.int64)
    odd = np.bincount(owner * 192 + bit, minlength=len(seqs) * 192).reshape(-1, 192) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the common and the united bag."""
    common = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
    return common, len(a) + len(b) - common


def coverage(a: np.ndarray, b: np.ndarray, k: int = GRAM) -> float:
    """Share of a's words that align with b: seeds of k words, the longest collinear chain of them, each extended while
    the words agree, and the gaps between neighbours aligned word by word. Exact for texts of any length and repetition:
    occurrences of a run pair up in bit-parallel rows, so no run is left out, and a gap takes its length times its
    length in machine words."""
    x, y = a.tolist(), b.tolist()
    if not x:
        return 0.0
    k = min(k, len(x), len(y))
    if not k:
        return 0.0
    matched, i0, j0 = 0, 0, 0
    for i, j in [*_chain(x, y, k), (len(x), len(y))]:
        if i < i0 or j < j0:  # overlaps what an earlier seed already covers on the same diagonal
            step = max(i0 - i, j0 - j)
            i, j = i + step, j + step
        matched += _common(x[i0:i], y[j0:j])
        i0, j0 = i, j
        while i0 < len(x) and j0 < len(y) and x[i0] == y[j0]:
            matched, i0, j0 = matched + 1, i0 + 1, j0 + 1
    return min(matched / len(x), 1.0)


def _chain(x: list[int], y: list[int], k: int) -> list[tuple[int, int]]:
    """A longest collinear chain of common runs of k words. Runs that both texts hold once are chained by patience sorting;
    between two of these the repeated ones are left to the alignment of the gap, which finds them all."""
    once = lambda t: {g: i for g, i in _places(t, k).items() if i >= 0}
    there = once(y)
    seeds = sorted((i, there[g]) for g, i in once(x).items() if g in there)
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(seeds)
    for s, (_, j) in enumerate(seeds):
        p = bisect_left(tails, j)
        back[s] = ends[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            ends.append(s)
        else:
            tails[p], ends[p] = j, s
    chain: list[tuple[int, int]] = []
    s = ends[-1] if ends else -1
    while s >= 0:
        chain.append(seeds[s])
        s = back[s]
    return chain[::-1]


def _places(t: list[int], k: int) -> dict[tuple[int, ...], int]:
    """The place of each run of k words, -1 for one that occurs again."""
    at: dict[tuple[int, ...], int] = {}
    for i in range(len(t) - k + 1):
        g = tuple(t[i : i + k])
        at[g] = -1 if g in at else i
    return at


def _common(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence of two gaps, a row of bits for each word of the longer one."""
    if not x or not y:
        return 0
    if len(x) > len(y):
        x, y = y, x
    masks: dict[int, int] = {}
    for i, u in enumerate(x):
        masks[u] = masks.get(u, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for v in y:
        if m := masks.get(v):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(x) - row.bit_count()


def frequencies(texts: DataFrame) -> np.ndarray:
    """By counter: how many times as frequent as the mean counter, as a binary logarithm, 0 for less than twice.

    Rare fingerprints share counters and are all 0; those of phrases that many texts hold stand out. A task holds and
    passes on COUNTERS numbers at most, and as many come to the driver and are broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int64)
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                lists = big.column(0).slice(at, SLICE)
                ends = lists.offsets.to_numpy()
                seqs = [lists.values.to_numpy()[ends[i] : ends[i + 1]] for i in range(len(ends) - 1)]
                held += np.bincount((grams(seqs)[0] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        slot = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(held[slot])], ["slot", "n"])

    rows = texts.select("seq").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS)
    counts[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return np.log2(np.maximum(counts * COUNTERS / max(counts.sum(), 1), 1)).astype(np.uint8)


def fingerprints(texts: DataFrame, levels: np.ndarray, side: int) -> DataFrame:
    """(sig, no, bits..) of texts (text_no, kind, seq), packed as compare.py has it: the winnowed fingerprints, rare before
    frequent ones. They have no place in a prefix."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, SLICE):
                b = big.slice(start, SLICE)
                lists = b.column(2)
                ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                seqs = [values[ends[i] : ends[i + 1]] for i in range(len(ends) - 1)]
                h, owner = grams(seqs)
                pick = winnow(h, owner, shared.value[(h % np.uint64(COUNTERS)).astype(np.int64)])
                salts = np.array([xxhash.xxh64_intdigest(k.encode()) for k in b.column(1).to_pylist()], np.uint64)
                pair = np.unique(np.stack([owner[pick].astype(np.uint64), h[pick]], 1), axis=0)
                own = pair[:, 0].astype(np.int64)
                fp = mix64(pair[:, 1] + salts[own])
                bits, n, no = parity(seqs), np.diff(ends).astype(np.int64), b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(pack(fp, n[own], 0, side)), pa.array(no[own]), *[pa.array(bits[own, c]) for c in range(3)]], NAMES)

    return texts.select("text_no", "kind", "seq").mapInArrow(run, SCHEMA)


def sequence_rows(df: DataFrame) -> DataFrame:
    """(kind, rec_id, loaded_at, split, source, seq_id, seq) of the rows of train and held-out splits that have words."""
    names = ["kind", "rec_id", "loaded_at", "split", "source", "seq_id", "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = Sequences()
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                seqs = turn.of(b.column(5).to_pylist())
                n = np.array([len(s) for s in seqs])
                ids = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in seqs], pa.binary())
                array = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(seqs)))
                yield pa.RecordBatch.from_arrays([*b.columns[:5], ids, array], names).filter(pa.array(n > 0))

    rows = df.filter(F.col("split").isin([TRAIN, *HELD_OUT]) & not_blank("text")).select("kind", "rec_id", "loaded_at", "split", "source", "text")
    return spread(rows, "rec_id", "loaded_at").mapInArrow(run, "kind string, rec_id bigint, loaded_at timestamp, split string, source string, seq_id binary, seq array<int>")


def exact_candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """(held_no, train_no): among others, all pairs across the splits whose bags agree by the threshold, whatever runs they
    share, so those that winnowing doesn't guarantee are there. texts: (text_no, kind, seq, in_train, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = b.column(2)
                ends = lists.offsets.to_numpy()
                code = elements(lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint32).astype(np.uint64), np.diff(ends))
                array = pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(code))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), array], ["bag_no", "kind", "bag"])

    schema = "bag_no bigint, kind string, bag array<int>"
    bags = lambda some: some.select(F.col("text_no").alias("bag_no"), "kind", "seq").mapInArrow(run, schema)
    return candidates_across(*(bags(texts.filter(side) if side else texts) for side in (None, "held_out", "in_train")), texts.count(), threshold).toDF("held_no", "train_no")


def cross_split(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(kind, held_id, train_id, held_split, held_source, similarity, coverage): records of valid or test with each record
    of train whose bag of words agrees by the threshold; coverage is the aligned share of the held-out record's words.

    Candidates share a winnowed fingerprint across the splits, or are found by the exact prefixes of near.py. Lengths and
    parity bits, which every pair above the threshold must satisfy, are tested within the join; the rest is chained,
    aligned and measured exactly. Equal texts
    are one text with several records. Null splits, null and blank texts take no part; no fingerprint is dropped, and a
    frequent one stands for a window only if all others in it are frequent too.
    """
    t = int(round(threshold * 100))
    rows = cut(sequence_rows(df))
    texts = cut(rows.groupBy("kind", "seq_id").agg(F.first("seq").alias("seq"), F.max(F.col("split") == TRAIN).alias("in_train"), F.max(F.col("split") != TRAIN).alias("held_out")).withColumn("text_no", F.monotonically_increasing_id()))
    last = first_per_key(rows, ["kind", "rec_id"], ["split", "source", "seq_id"], "loaded_at")
    members = cut(last.join(texts.select("kind", "seq_id", "text_no"), ["kind", "seq_id"]).select("kind", "rec_id", "split", "source", "text_no"))
    discard(rows)
    levels = frequencies(texts)
    rows = fingerprints(texts.filter("held_out"), levels, 0).unionAll(fingerprints(texts.filter("in_train"), levels, 1))
    pairs = close_pairs(rows, threshold, across=True).toDF("held_no", "train_no")
    pairs = pairs.unionByName(exact_candidates(texts, threshold)).distinct()
    full = pairs.join(texts.select(F.col("text_no").alias("held_no"), F.col("seq").alias("held_seq")), "held_no").join(texts.select(F.col("text_no").alias("train_no"), F.col("seq").alias("train_seq")), "train_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, tr, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.array(x, np.int32), np.array(y, np.int32)
                common, united = similarity(x, y)
                if common * 100 >= united * t:
                    out.append((h, tr, common / united, coverage(x, y)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["held_no", "train_no", "similarity", "coverage"])

    found = full.select("held_no", "train_no", "held_seq", "train_seq").mapInArrow(run, "held_no bigint, train_no bigint, similarity double, coverage double")
    held = members.filter(F.col("split") != TRAIN).select("kind", F.col("rec_id").alias("held_id"), F.col("split").alias("held_split"), F.col("source").alias("held_source"), F.col("text_no").alias("held_no"))
    train = members.filter(F.col("split") == TRAIN).select(F.col("rec_id").alias("train_id"), F.col("text_no").alias("train_no"))
    apart = held.join(found, "held_no").join(train, "train_no")
    same = held.join(train.withColumnRenamed("train_no", "held_no"), "held_no").withColumn("similarity", F.lit(1.0)).withColumn("coverage", F.lit(1.0))
    columns = ["kind", "held_id", "train_id", "held_split", "held_source", "similarity", "coverage"]
    return apart.select(*columns).unionByName(same.select(*columns))


def as_pairs(found: DataFrame) -> DataFrame:
    """(kind, id_low, id_high)."""
    return found.select("kind", F.least("held_id", "train_id").alias("id_low"), F.greatest("held_id", "train_id").alias("id_high")).distinct()


def overlap_report(found: DataFrame) -> DataFrame:
    """Per kind, held-out split and source: pairs, records with a counterpart in train, and their mean best coverage."""
    best = found.groupBy("kind", "held_split", "held_source", "held_id").agg(F.count("*").alias("n"), F.max("coverage").alias("c"))
    return best.groupBy("kind", F.col("held_split").alias("split"), F.col("held_source").alias("source")).agg(F.sum("n").alias("pairs"), F.count("*").alias("records"), F.round(F.avg("c"), 6).alias("mean_coverage"))
