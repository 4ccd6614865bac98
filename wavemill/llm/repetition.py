"""Problem 3: the share of repeated content within each text, judged by weak supervision.

A case is defined by an exact share, so the rule that measures it enters the label model as an anchor of given accuracy;
expectation-maximisation learns the accuracies of the other rules by it, and the posterior decides.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, first_per_key, mix64, spread, words  # noqa: F401
from .labelmodel import posteriors

RUN = 5
SHARE = 0.4
#: Records whose posterior reaches this are cases.
CUTOFF = 0.5
#: The rule that measures what a case is defined by, and its accuracy, which outweighs all others together.
ANCHOR = {"runs": 1 - 1e-9}
SLICE = 4096
RULES = ["runs", "sentences", "variety", "trigram", "compression"]
SENTENCE = re.compile(r"[.!?。！？\n]+")


class Runs:
    """Measures of a batch of texts, vectorised over all their words."""

    def __init__(self, run: int = RUN):
        self.run, self.seen = run, {}

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words that aren't digits only, and the text each belongs to."""
        parts = [words(t) for t in texts]
        if len(self.seen) > 500_000:
            self.seen.clear()
        for w in {w for p in parts for w in p} - self.seen.keys():
            self.seen[w] = 0 if w.isnumeric() else xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) or 1
        flat = np.fromiter((self.seen[w] for p in parts for w in p), np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        return flat[flat != 0], owner[flat != 0]

    @staticmethod
    def grams(ids: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each position, with the text mixed in; positions where n words of one text begin."""
        m = len(ids) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = mix64(owner[:m].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for k in range(n):
            h = mix64(h * np.uint64(0x2545F4914F6CDD1D) + ids[k : k + m])
        at = np.flatnonzero(owner[:m] == owner[n - 1 :])
        return h[at], at

    def repeated(self, ids: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Marks each word that lies in a run which occurred earlier in its text."""
        h, at = self.grams(ids, owner, self.run)
        order = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + self.run, -1)
        return np.cumsum(edge[:-1]) > 0

    def measure(self, texts: list[str]) -> dict[str, np.ndarray]:
        n = len(texts)
        ids, owner = self.ids(texts)
        words = np.bincount(owner, minlength=n)
        safe = np.maximum(words, 1)
        marks = self.repeated(ids, owner)
        repeated = np.bincount(owner, marks, n).astype(np.int64)
        different = np.bincount(owner[np.unique(mix64(owner.astype(np.uint64)) ^ ids, return_index=True)[1]], minlength=n)
        h, at = self.grams(ids, owner, 3)
        _, first, count = np.unique(h, return_index=True, return_counts=True)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, owner[at[first]], count)
        twice = np.zeros(n)
        small = np.zeros(n)
        for i, t in enumerate(texts):
            parts = [s.strip().lower() for s in SENTENCE.split(t)]
            sizes: dict[str, int] = {}
            again = total = 0
            for s in parts:
                total += len(s)
                again += len(s) if s in sizes else 0
                sizes[s] = 1
            twice[i] = again / max(total, 1)
            raw = t.encode("utf-8", "surrogatepass")
            small[i] = len(zlib.compress(raw, 1)) / max(len(raw), 1)
        return {"words": words, "repeated": repeated, "share": repeated / safe, "sentences": twice, "variety": different / safe, "trigram": 3 * top / safe, "compression": small}


def vote(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The rules. The first is the definition itself and never abstains; each other abstains between its two bounds, and on
    texts too short for it."""
    n, long = m["words"], m["words"] >= 20

    def sides(value, case, rest, usable=True):
        return np.where(usable & (value >= case), 1, np.where(usable & (value <= rest), -1, 0)).astype(np.int32)

    return {
        "runs": np.where(m["repeated"] >= SHARE * np.maximum(n, 1) - 1e-9, 1, -1).astype(np.int32),
        "sentences": sides(m["sentences"], 0.3, 0.02, n >= RUN),
        "variety": sides(-m["variety"], -0.45, -0.65, long),
        "trigram": sides(m["trigram"], 0.15, 0.1, long),
        "compression": sides(-m["compression"], -0.32, -0.48, long),
    }


def repetition(df: DataFrame, key: list[str], text_col: str = "thinking", order: str = "loaded_at") -> DataFrame:
    """(key.., n_words, n_repeated, repeated_share, posterior): one row per record.

    n_words counts the words that aren't digits only; a word is repeated if it lies in five consecutive words that
    occurred earlier in the text. Null, empty and blank texts and texts under five words have share 0. Of a record
    delivered several times the last delivery counts. Whole texts are measured where they are read; only the
    measures are shuffled. The result is written once, as the label model needs the pattern counts first.
    """
    names = [*key, order, "n_words", "n_repeated", "repeated_share", *RULES]
    of = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"`{k}` {of[k]}" for k in [*key, order]] + ["n_words bigint, n_repeated bigint, repeated_share double"] + [f"`{r}` int" for r in RULES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                m = runs.measure([t or "" for t in b.column(len(key) + 1).to_pylist()])
                v = vote(m)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(key) + 1], pa.array(m["words"].astype(np.int64)), pa.array(m["repeated"]), pa.array(m["share"]), *[pa.array(v[r]) for r in RULES]], names)

    rows = spread(df.select(*key, order, text_col), *key, order).mapInArrow(run, schema)
    one = cut(first_per_key(rows, key, names[len(key) + 1 :], order))
    return posteriors(one, RULES, anchors=ANCHOR).select(*key, "n_words", "n_repeated", "repeated_share", "posterior")


def repetitive(measured: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Records that the label model holds for repetitive: the posterior alone decides."""
    return measured.filter(F.col("posterior") >= cutoff)


def both_kinds(qa: DataFrame, captions: DataFrame) -> DataFrame:
    """kind, rec_id, thinking, loaded_at of questions and captions."""
    a = qa.select(F.lit("qa").alias("kind"), F.col("qa_id").alias("rec_id"), "thinking", "loaded_at")
    return a.unionByName(captions.select(F.lit("caption").alias("kind"), F.col("caption_id").alias("rec_id"), "thinking", "loaded_at"))
