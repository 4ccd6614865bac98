"""Word counts over all texts of a corpus, kept in files that all executors share and looked up by hash.

Neither the counts nor the files have a bound, so nothing of them is collected or broadcast: tasks write sorted arrays to
the shared folder, workers map these into memory. Words are known by 55 bits of a hash.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import chain, repeat
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, scratch

#: Counts that a task holds before it passes them on, and words that a worker remembers.
HELD, CACHED = 200_000, 1 << 16
MASK = (1 << 55) - 1
SLICE = 1024


def word_key(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") & MASK


def word_keys(words: list[str]) -> np.ndarray:
    digests = b"".join([blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in words])
    return np.frombuffer(digests, "<i8") & MASK


def prefix_keys(word: str) -> Iterator[int]:
    """word_key of each prefix, the word itself last, in time linear in the word."""
    h = blake2b(digest_size=8)
    for c in word:
        h.update(c.encode("utf-8", "surrogatepass"))
        yield int.from_bytes(h.copy().digest(), "little") & MASK


def bucket(n: int) -> int:
    return 0 if n == 0 else 1 if n < 3 else 2 if n < 20 else 3


def known_keys(counts: Iterable[tuple[str, int]]) -> dict[int, list[int]]:
    """By key: the bucket of the word's own count, and that of the most frequent longer word that begins with it."""
    found: dict[int, list[int]] = {}
    for word, n in counts:
        b, last = bucket(n), None
        for k in prefix_keys(word):
            if last is not None:
                x = found.setdefault(last, [0, 0])
                x[1] = max(x[1], b)
            last = k
        if last is not None:
            x = found.setdefault(last, [0, 0])
            x[0] = max(x[0], b)
    return found


class Memory:
    """The table of a corpus that is at hand."""

    def __init__(self, counts: Iterable[tuple[str, int]]):
        self.values = {k: s * 4 + g for k, (s, g) in known_keys(counts).items()}

    def get(self, word: str) -> int:
        return self.values.get(word_key(word), 0)


class Table:
    """The table of a corpus in files: one sorted array for each remainder of the key, key and value in one number."""

    def __init__(self, folder: str, parts: int):
        self.__setstate__((folder, parts))

    def __getstate__(self):
        return self.folder, self.parts

    def __setstate__(self, state) -> None:
        self.folder, self.parts = state
        self.files: dict[int, np.ndarray | None] = {}
        self.cache: dict[str, int] = {}

    def get(self, word: str) -> int:
        """The value of a word, 0 if it has none."""
        if (v := self.cache.get(word)) is not None:
            return v
        v, k = 0, word_key(word)
        if (a := self.file(k % self.parts)) is not None:
            i = int(a.searchsorted(k << 8))
            if i < len(a) and int(a[i]) >> 8 == k:
                v = int(a[i]) & 255
        if len(word) <= 100:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[word] = v
        return v

    def file(self, slot: int) -> np.ndarray | None:
        if slot not in self.files:
            path = f"{self.folder}/{slot}.npy"
            self.files[slot] = np.asarray(np.load(path, mmap_mode="r")) if os.path.exists(path) else None
        return self.files[slot]

    def get_all(self, words: list[str]) -> np.ndarray:
        """get of each word, which aren't remembered."""
        keys, out = word_keys(words), np.zeros(len(words), np.int64)
        slots = keys % self.parts
        order = np.argsort(slots, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(slots[order])) + 1) if len(words) else ():
            if (a := self.file(int(slots[mine[0]]))) is not None:
                k = keys[mine]
                there = a[np.minimum(a.searchsorted(k << 8), len(a) - 1)]
                out[mine] = np.where(there >> 8 == k, there & 255, 0)
        return out


def save(values: DataFrame) -> Table:
    """Writes (h, v), one row a key, v from 1 to 255, to the shared folder. The files go when the driver ends."""
    spark = values.sparkSession
    place = urlparse(scratch(spark, "words"))
    if place.scheme not in ("", "file"):
        raise ValueError(f"the checkpoint folder must be a mounted one: {place.geturl()}")
    folder, parts = place.path, int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(t: pa.Table) -> pa.Table:
        h = t.column("h").to_numpy()
        slot = int(h[0]) % parts
        mine = f"{folder}/{uuid.uuid4().hex}"
        with open(mine, "wb") as f:
            np.save(f, np.sort(h << 8 | t.column("v").to_numpy()))
        os.replace(mine, f"{folder}/{slot}.npy")  # another attempt of the task writes the same
        return pa.table({"slot": pa.array([slot], pa.int32())})

    values.select("h", F.col("v").cast("bigint").alias("v"), (F.col("h") % parts).alias("slot")).groupBy("slot").applyInArrow(write, "slot int").collect()
    return Table(folder, parts)


def count_words(texts: DataFrame, tally: Callable[[list[str]], Iterator[tuple[str, list[str]]]]) -> DataFrame:
    """(list, word, n) over all different texts of the first column; tally gives lists of words of texts, each with its name."""
    column = texts.columns[0]
    different = texts.filter(F.col(column).isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, Counter[str]] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            columns = [x for name, c in held.items() for x in repeat(name, len(c))], list(chain(*held.values())), list(chain(*(c.values() for c in held.values())))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["list", "word", "n"])

        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                for name, words in tally(big.column(0).slice(at, SLICE).to_pylist()):
                    held[name].update(words)
                    if len(held[name]) > HELD:
                        yield out()
                if sum(map(len, held.values())) > HELD:
                    yield out()
        yield out()

    return cut(different.mapInArrow(run, "list string, word string, n bigint").groupBy("list", "word").agg(F.sum("n").alias("n")))


def known_table(counts: DataFrame) -> Table:
    """From (word, n), for every word and every prefix of one: 4 times the bucket of its count, and that of the most frequent longer word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for found in by_size(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x[0] for x in found.values()], pa.int32()), pa.array([x[1] for x in found.values()], pa.int32())], ["h", "own", "longer"])

    def by_size(counts: Iterable[tuple[str, int]]) -> Iterator[dict[int, list[int]]]:
        some, size = [], 0
        for x in counts:
            some.append(x)
            size += len(x[0])
            if size > HELD:
                yield known_keys(some)
                some, size = [], 0
        yield known_keys(some)

    keys = counts.select("word", "n").mapInArrow(run, "h bigint, own int, longer int")
    return save(keys.groupBy("h").agg((F.max("own") * 4 + F.max("longer")).alias("v")))


def value_table(values: DataFrame) -> Table:
    """From (word, v), one row a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_key(w) for w in b.column(0).to_pylist()], pa.int64()), b.column(1)], ["h", "v"])

    return save(values.select("word", F.col("v").cast("int").alias("v")).mapInArrow(run, "h bigint, v int").groupBy("h").agg(F.max("v").alias("v")))


def most_frequent(counts: DataFrame, most: int) -> list[str]:
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]
