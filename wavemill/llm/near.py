"""Problem 5: near-duplicate records by token-combination prefixes, then exact verification.

A text is the bag of its words; the n-th occurrence of a word is an element of its own, so bags become sets. Elements
have one global order, rare ones first. Two records that agree by the threshold can differ in only so many elements;
every record therefore indexes a prefix of its ordered elements. Rare elements are indexed alone, frequent ones only in
pairs or triples taken within fixed groups of elements, as a single frequent word tells too little. A group of
c elements in a prefix is worth c - k + 1, since that many must be lost before none of its k-combinations is left; the
prefix is extended until it is worth one more than what may differ. So each pair above the threshold shares a combination.

How many are combined follows from the share of the bags that hold an element, so a bag has about as many signatures in a
collection of any size, while the bags that share one grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, first_per_key, mix64, not_blank, spread, words
from .compare import NAMES, SCHEMA, close_pairs, pack
from .components import components

THRESHOLD = 0.7
#: Elements up to the first share of the bags are indexed alone, up to the second in pairs, the rest in triples.
SHARES = (0.01, 0.05)
MOST = len(SHARES) + 1
#: Counters of elements: a table of fixed size, whatever the vocabulary. Elements that share one count as equally frequent.
COUNTERS = 1 << 20
#: Elements of so few bags are indexed alone whatever their share.
FEW = 8
#: Groups of elements whose members are combined, by number combined: the next row is for records whose whole text isn't
#: worth enough by the row before. Those not worth enough by the last have few elements and index whole subsets.
GROUPS = [{1: 1, 2: 6, 3: 16}, {1: 1, 2: 2, 3: 4}, {1: 1, 2: 1, 3: 1}]
#: From so many bags on, where all pairs of a collection are looked for, comparisons cost more than signatures: fewer
#: elements are indexed alone and in pairs, and pairs have more groups. Measured on the check's larger input: 65 signatures
#: a bag instead of 50, and half the comparisons.
MANY, SHARES_OF_MANY, GROUPS_OF_MANY = 2_000_000, (0.003, 0.03), [{1: 1, 2: 8, 3: 14}, *GROUPS[1:]]
#: Longer records have more groups, so that these stay small: from so many elements on, and then at each fourfold size,
#: there is a row of four times as many before.
LONG = 300
SLICE = 2048


class Bags:
    """Turns texts into sorted arrays of element codes of 32 bits, to keep shuffled bags small.

    Two different elements of a pair of texts take one code about once in a million pairs; this could matter only to a
    pair that misses the threshold by a single word.
    """

    def __init__(self):
        self.seen: dict[str, int] = {}

    def of(self, texts: list[str]) -> list[np.ndarray]:
        parts = [words(t) for t in texts]
        if len(self.seen) > 500_000:
            self.seen.clear()
        for w in {w for p in parts for w in p} - self.seen.keys():
            self.seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        sizes = np.array([len(p) for p in parts], np.int64)
        code = elements(np.fromiter((self.seen[w] for p in parts for w in p), np.uint64), sizes)
        return np.split(code, np.cumsum(sizes)[:-1])


def elements(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Element codes of texts of so many word codes each, sorted within a text: the n-th time that a word occurs in it is
    another element."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((flat, owner))
    flat = flat[order]
    start = np.ones(len(flat), bool)
    start[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(flat))
    nth = at - np.maximum.accumulate(np.where(start, at, 0))
    code = mix64(flat + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    code = (code >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return code[np.lexsort((code, owner))]


def bag_rows(df: DataFrame) -> DataFrame:
    """(kind, rec_id, loaded_at, split, bag_id, bag) of rows (kind, rec_id, loaded_at, split, text); blank texts and
    texts without words take no part. bag_id is a hash of the bag of 128 bits, equal for texts with equal bags."""
    names = ["kind", "rec_id", "loaded_at", "split", "bag_id", "bag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags()
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                sets = bags.of(b.column(4).to_pylist())
                ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                lengths = np.array([len(s) for s in sets])
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
                keep = pa.array(lengths > 0)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.binary()), array], names).filter(keep)

    rows = df.filter(not_blank("text")).select("kind", "rec_id", "loaded_at", "split", "text")
    return spread(rows, "rec_id", "loaded_at").mapInArrow(run, "kind string, rec_id bigint, loaded_at timestamp, split string, bag_id binary, bag array<int>")


def slots(codes: np.ndarray) -> np.ndarray:
    """The counter of each element code of 32 bits."""
    return codes.astype(np.int64) & (COUNTERS - 1)


def frequencies(bags: DataFrame) -> np.ndarray:
    """By counter: eight times the binary logarithm of the number of bags, 0 for those of one bag or none.

    At most COUNTERS rows of five bytes come to the driver, and as many bytes are broadcast, however many bags there are.
    """
    per = bags.select(F.explode("bag").alias("code")).groupBy(F.col("code").bitwiseAND(F.lit(COUNTERS - 1)).alias("slot")).count()
    rows = per.filter("count > 1").select("slot", F.round(F.log2("count") * 8).cast("smallint").alias("level")).toArrow()
    out = np.zeros(COUNTERS, np.uint16)
    out[rows.column("slot").to_numpy()] = rows.column("level").to_numpy()
    return out


def combined(levels: np.ndarray, count: int, many: bool = False) -> np.ndarray:
    """How many elements of each level are combined, among so many bags."""
    bags = np.exp2(levels / 8.0)
    return np.where(bags <= FEW, 1, 1 + np.searchsorted(np.array(SHARES_OF_MANY if many else SHARES), bags / max(count, 1), side="left"))


def rows_of(longest: int, threshold: int, many: bool = False) -> Iterator[tuple[int, int, dict[int, int]]]:
    """Rows of groups, the finest first: the size from which records use it, the size from which they may stop at it, as
    all their partners use it, and the groups."""
    sizes, table = [], GROUPS_OF_MANY if many else GROUPS
    while LONG * 4 ** len(sizes) <= longest:
        sizes.append(LONG * 4 ** len(sizes))
    for i, least in reversed(list(enumerate(sizes, 1))):
        yield least, -(-least * 100 // threshold), {k: 1 if k == 1 else n * 4**i for k, n in table[0].items()}
    for groups in table:
        yield 0, 0, groups


class Signer:
    """Signatures of a batch of bags."""

    def __init__(self, levels: np.ndarray, count: int, threshold: float, many: bool = False):
        self.levels, self.t, self.many = levels, int(round(threshold * 100)), many
        self.by_level = combined(np.arange(int(levels.max(initial=0)) + 1), count, many)
        self.picks: dict[tuple[int, int], np.ndarray] = {}

    def pick(self, j: int, k: int) -> np.ndarray:
        """All k-subsets of range(j), a row each."""
        if (j, k) not in self.picks:
            self.picks[j, k] = np.array(list(combinations(range(j), k)), np.int64).reshape(-1, k)
        return self.picks[j, k]

    def overlap(self, n: int, m: int) -> int:
        """Elements that bags of n and m have in common at least if they agree by the threshold."""
        return -(-self.t * (n + m) // (100 + self.t))

    def level(self, flat: np.ndarray, owner: np.ndarray, probe: np.ndarray, groups: dict[int, int]):
        """(signature, owner, worth before it) by one row of groups, and which records aren't worth enough by it.
        Where two rows have as many groups of a kind, the signatures are the same."""
        rank = self.levels[slots(flat)]
        order = np.lexsort((flat, rank, owner))
        flat, owner, size = flat[order], owner[order], self.by_level[rank[order]]
        parts = np.array([1, *[groups[k] for k in range(1, MOST + 1)]], np.uint64)
        hashed = mix64(flat.view(np.uint64))
        group = size * (1 << 32) + (hashed % parts[size]).astype(np.int64)
        within = np.lexsort((group, owner))  # stable: the order of ranks stays within a group
        g, o = group[within], owner[within]
        start = np.ones(len(flat), bool)
        start[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
        place = np.arange(len(flat))
        first = np.maximum.accumulate(np.where(start, place, 0))
        nth = np.empty(len(flat), np.int64)
        nth[within] = place - first
        spot = np.empty(len(flat), np.int64)  # where the element stands in the grouped order
        spot[within] = place
        worth = (nth >= size - 1).astype(np.int64)
        before = np.cumsum(worth) - worth
        head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        before = before - np.repeat(before[head], np.diff(np.r_[head, len(flat)]))
        in_probe = before < probe[owner]
        whole = np.bincount(owner, worth, len(probe))
        sigs, owners, places = [], [], []
        grouped = hashed[within]
        for k in range(1, MOST + 1):
            mine = np.flatnonzero(in_probe & (size == k) & (nth >= k - 1))
            for j in np.unique(nth[mine]) if k > 1 else ([0] if len(mine) else []):
                rows = mine[nth[mine] == j] if k > 1 else mine
                own = grouped[spot[rows]]
                if k == 1:
                    h = own[:, None]
                else:
                    pick = self.pick(int(j), k - 1)
                    begin = spot[rows] - j
                    h = np.repeat(own[:, None], len(pick), 1)
                    for c in range(k - 1):
                        h = h * np.uint64(0x2545F4914F6CDD1D) + grouped[begin[:, None] + pick[None, :, c]]
                sigs.append(mix64((h + np.uint64(groups[k] * 7 + k)).ravel()))
                owners.append(np.repeat(owner[rows], h.shape[1]))
                places.append(np.repeat(before[rows], h.shape[1]))
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return join(sigs, np.uint64), join(owners, np.int64), join(places, np.int64), whole < probe

    def subsets(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """Signatures of every subset that a partner of some size has in common at least."""
        n, done = len(codes), set()
        hashed = np.sort(mix64(codes.view(np.uint64)))
        for m in [*range(n, 0, -1), *range(n + 1, n * 100 // self.t + 1)]:
            k = self.overlap(n, m)
            if k > min(n, m) or min(n, m) * 100 < max(n, m) * self.t:
                continue
            if k in done:
                continue
            done.add(k)
            h = np.zeros(len(self.pick(n, k)), np.uint64)
            for c in range(k):
                h = h * np.uint64(0x2545F4914F6CDD1D) + hashed[self.pick(n, k)[:, c]]
            yield mix64(h + np.uint64(1000 + k))

    def sign(self, sets: list[np.ndarray], salts: np.ndarray):
        """(signature, owner, in the shorter prefix) of all records, and their sizes."""
        sig, own, place, n = self.place(sets, salts)
        need = n - -(-2 * self.t * n // (100 + self.t)) + 1
        return sig, own, place < need[own], n

    def place(self, sets: list[np.ndarray], salts: np.ndarray):
        """(signature, owner, place) by all rows of GROUPS that a record needs, and the sizes; salts keep the kinds of
        records apart. The place is what the prefix is worth before the combination's last element. Records that may lack
        d elements of each other's share a signature whose place is d at most in both."""
        n = np.array([len(s) for s in sets], np.int64)
        t = self.t
        probe = n - -(-t * n // 100) + 1
        left, out = np.arange(len(sets)), []
        for least, enough, groups in rows_of(int(n.max()), t, self.many):
            use = left[n[left] >= least]
            if not len(use):
                continue
            flat = np.concatenate([sets[i] for i in use])
            owner = np.repeat(np.arange(len(use)), n[use])
            sig, own, place, short = self.level(flat, owner, probe[use], groups)
            out.append((sig, use[own], place))
            left = np.setdiff1d(left, use[~short & (n[use] >= enough)], assume_unique=True)
        for i in left.tolist():
            for sig in self.subsets(sets[i]):
                out.append((sig, np.full(len(sig), i), np.zeros(len(sig), np.int64)))
        sig, own, place = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((place, sig, own))  # rows of one record side by side: what they share compresses well
        sig, own, place = sig[order], own[order], place[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])]  # several rows may give the same
        return mix64(sig[new] + salts[own[new]]), own[new], place[new], n

    @staticmethod
    def bitmaps(sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        """192 parity bits a record: sets that differ in d elements differ in at most d bits."""
        owner = np.repeat(np.arange(len(sets)), n)
        bit = (mix64(np.concatenate(sets).view(np.uint64)) % np.uint64(192)).astype(np.int64)
        odd = np.bincount(owner * 192 + bit, minlength=len(sets) * 192).reshape(-1, 192) & 1
        return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def signatures(bags: DataFrame, levels: np.ndarray, count: int, threshold: float, side: int = 0, many: bool = False) -> DataFrame:
    """(sig, no, bits_a, bits_b, bits_c) of bags (bag_no, kind, bag), packed as compare.py has it.

    40 bits of the signature are kept; equal signatures of different combinations only cost a comparison.
    """
    shared = bags.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(shared.value, count, threshold, many)
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                lists = b.column(2)
                values, ends = lists.values.to_numpy().astype(np.int64), lists.offsets.to_numpy()
                sets = [values[ends[i] : ends[i + 1]] for i in range(len(ends) - 1)]
                salts = np.array([xxhash.xxh64_intdigest(k.encode()) for k in b.column(1).to_pylist()], np.uint64)
                sig, own, place, n = signer.place(sets, salts)
                bits = signer.bitmaps(sets, n)
                no = b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(pack(sig, n[own], place, side)), pa.array(no[own]), *[pa.array(bits[own, c]) for c in range(3)]], NAMES)

    return bags.select("bag_no", "kind", "bag").mapInArrow(run, SCHEMA)


def _verified(pairs: DataFrame, bags: DataFrame, t: int) -> DataFrame:
    """Of pairs (low_no, high_no) those whose bags agree by the threshold."""
    low = bags.select(F.col("bag_no").alias("low_no"), F.col("bag").alias("low_bag"))
    high = bags.select(F.col("bag_no").alias("high_no"), F.col("bag").alias("high_bag"))
    both = pairs.join(low, "low_no").join(high, "high_no")
    common = F.size(F.array_intersect("low_bag", "high_bag"))
    return both.filter(common * (100 + t) >= (F.size("low_bag") + F.size("high_bag")) * t).select("low_no", "high_no")


def similar_bags(bags: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(low_no, high_no): all pairs of different bags of one kind whose multiset Jaccard similarity is >= threshold.

    bags: (bag_no, kind, bag), read several times. What is collected and broadcast is the table of frequencies, of fixed
    size. The signatures are shuffled once.
    """
    t = int(round(threshold * 100))
    count = bags.count()
    rows = signatures(bags, frequencies(bags), count, threshold, many=count >= MANY)
    return _verified(close_pairs(rows, threshold), bags, t)


def candidates_across(bags: DataFrame, left: DataFrame, right: DataFrame, count: int, threshold: float = THRESHOLD) -> DataFrame:
    """(left_no, right_no): among others, all pairs of a bag of left and another of its kind of right that agree by the
    threshold; they are still to be verified. bags holds all of both, so many.

    The signatures are shuffled once, and only bags of different sides are compared.
    """
    levels = frequencies(bags)
    rows = signatures(left, levels, count, threshold, 0).unionAll(signatures(right, levels, count, threshold, 1))
    return close_pairs(rows, threshold, across=True)


def members_and_bags(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (kind, rec_id, split, bag_no), one per record, and the different bags (bag_no, kind, bag), both written.

    A record delivered several times counts with its last delivery; records with equal bags share one bag.
    """
    rows = cut(bag_rows(df))
    bags = cut(rows.groupBy("kind", "bag_id").agg(F.first("bag").alias("bag")).withColumn("bag_no", F.monotonically_increasing_id()))
    last = first_per_key(rows, ["kind", "rec_id"], ["split", "bag_id"], "loaded_at")
    members = cut(last.join(bags.select("kind", "bag_id", "bag_no"), ["kind", "bag_id"]).select("kind", "rec_id", "split", "bag_no"))
    discard(rows)
    return members, bags.select("bag_no", "kind", "bag")


def record_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, id_low, id_high, split_low, split_high): pairs of records whose bags are equal or a given pair."""
    a = members.select(F.col("bag_no").alias("low_no"), "kind", F.col("rec_id").alias("a"), F.col("split").alias("sa"))
    b = members.select(F.col("bag_no").alias("high_no"), F.col("rec_id").alias("b"), F.col("split").alias("sb"))
    same = a.join(b.withColumnRenamed("high_no", "low_no"), "low_no").filter("a < b").select("kind", "a", "b", "sa", "sb")
    apart = a.join(pairs, "low_no").join(b, "high_no").select("kind", "a", "b", "sa", "sb")
    turn = F.col("a") <= F.col("b")
    return same.unionByName(apart).select(
        "kind", F.least("a", "b").alias("id_low"), F.greatest("a", "b").alias("id_high"), F.when(turn, F.col("sa")).otherwise(F.col("sb")).alias("split_low"), F.when(turn, F.col("sb")).otherwise(F.col("sa")).alias("split_high")
    )


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(kind, id_low, id_high, split_low, split_high): all pairs of different records of one kind that agree by the
    threshold. Null and blank texts and texts without words take no part; no pair is capped or sampled away."""
    members, bags = members_and_bags(df)
    return record_pairs(members, similar_bags(bags, threshold))


def duplicate_groups(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(kind, rec_id, class_id, links): every record that has words, the smallest record id of its group, and with how
    many records it agrees by the threshold. Groups are tied over any number of links; a record without links is alone."""
    members, bags = members_and_bags(df)
    pairs = cut(similar_bags(bags, threshold))
    sizes = members.groupBy("bag_no").agg(F.count("*").alias("size"))
    both = pairs.unionByName(pairs.select(F.col("high_no").alias("low_no"), F.col("low_no").alias("high_no")))
    others = both.join(sizes.withColumnRenamed("bag_no", "high_no"), "high_no").groupBy(F.col("low_no").alias("bag_no")).agg(F.sum("size").alias("others"))
    classes = sizes.join(components(pairs, "low_no", "high_no").withColumnRenamed("node", "bag_no"), "bag_no", "left").join(others, "bag_no", "left")
    classes = classes.select("bag_no", F.coalesce("root", "bag_no").alias("class_no"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    placed = members.join(classes, "bag_no")
    first = placed.groupBy("class_no").agg(F.min("rec_id").alias("class_id"))
    return placed.join(first, "class_no").select("kind", "rec_id", "class_id", "links")


def question_and_caption_texts(qa: DataFrame, captions: DataFrame) -> DataFrame:
    a = qa.select(F.lit("qa").alias("kind"), F.col("qa_id").alias("rec_id"), "loaded_at", "split", "source", F.col("question").alias("text"))
    return a.unionByName(captions.select(F.lit("caption").alias("kind"), F.col("caption_id").alias("rec_id"), "loaded_at", "split", "source", F.col("answer").alias("text")))
