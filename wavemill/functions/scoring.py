"""Scores of predictions against references: row functions that emit counts, to be summed natively."""

from __future__ import annotations

import re
from collections import Counter
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .vectors import let

EDITS = ["hits", "substitutions", "deletions", "insertions"]
COUNTS = ["prediction_length", "reference_length", *[f"{k}{n}" for n in range(1, 5) for k in "mt"]]


def _longs(names: list[str]) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def edit_counts(reference: str, prediction: str) -> tuple[int, int, int, int]:
    """Hits, substitutions, deletions and insertions of a cheapest word alignment."""
    r, p = reference.split(), prediction.split()
    width = len(p) + 1
    cost = np.zeros((len(r) + 1, width), np.int32)
    cost[:, 0], cost[0, :] = np.arange(len(r) + 1), np.arange(width)
    codes: dict[str, int] = {}
    pc = np.array([codes.setdefault(w, len(codes)) for w in p], np.int64)
    steps = np.arange(width)
    for i, w in enumerate(r, 1):
        same = pc != codes.get(w, -1)
        best = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + same)
        row = np.r_[i, best] - steps  # insertions are a running minimum along the row
        cost[i] = np.minimum.accumulate(row) + steps
    i, j, hits, subs, dels, ins = len(r), len(p), 0, 0, 0, 0
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (r[i - 1] != p[j - 1]):
            hits, subs = hits + (r[i - 1] == p[j - 1]), subs + (r[i - 1] != p[j - 1])
            i, j = i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            dels, i = dels + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return hits, subs, dels, ins


@F.pandas_udf(_longs(EDITS))
def word_edits(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    rows = [edit_counts(r or "empty", p or "empty") for r, p in zip(reference, prediction)]
    return pd.DataFrame(rows, columns=EDITS)


def word_error_rate(df: DataFrame, reference: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """Corpus rate: errors over reference words, both summed; a null or empty side counts as the word 'empty'."""
    e = df.select(*(by or []), word_edits(F.coalesce(reference, F.lit("")), F.coalesce(prediction, F.lit(""))).alias("e"))
    wrong = F.sum(F.col("e.substitutions") + F.col("e.deletions") + F.col("e.insertions"))
    words = F.sum(F.col("e.substitutions") + F.col("e.deletions") + F.col("e.hits"))
    return e.groupBy(*(by or [])).agg(wrong.alias("errors"), words.alias("words"), (wrong / words).alias("wer"))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space."""

    def runs(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0)))
        joined = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(t, i + k) for k in range(n)]))
        return F.when(F.size(t) >= n, joined).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def clipped_matches(prediction: list[str], references: list[list[str]], n: int) -> tuple[int, int]:
    grams = lambda t: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    mine, most = grams(prediction), Counter()
    for r in references:
        most |= grams(r)
    return sum((mine & most).values()), sum(mine.values())


def bleu_tokens(s: str) -> list[str]:
    """Words and single punctuation marks; ideographs one by one."""
    return re.findall(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+|[^\w\s]", s)


@F.pandas_udf(_longs(COUNTS))
def bleu_counts(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    rows = []
    for p, r in zip(prediction, reference):
        a, b = bleu_tokens(p or ""), bleu_tokens(r or "")
        rows.append([len(a), len(b), *[x for n in (1, 2, 3, 4) for x in clipped_matches(a, [b], n)]])
    return pd.DataFrame(rows, columns=COUNTS)


def bleu_of(sums: dict[str, int], order: int = 4) -> float:
    """Corpus BLEU in [0, 1] of summed counts; an order without matches is smoothed by halving, as often as it occurs."""
    logs, halve = 0.0, 1.0
    for n in range(1, order + 1):
        m, t = sums[f"m{n}"], sums[f"t{n}"]
        if t == 0:
            return 0.0
        if m == 0:
            halve *= 2
            m = 1 / halve
        logs += log(m / t) / order
    p, r = sums["prediction_length"], sums["reference_length"]
    return (1.0 if p >= r else exp(1 - r / max(p, 1))) * exp(logs) if p else 0.0


def corpus_bleu(df: DataFrame, prediction: str, reference: str, order: int = 4) -> DataFrame:
    """One row: counts are made per row and summed in two phases; only ten sums reach the formula."""
    names = COUNTS
    sums = df.select(bleu_counts(prediction, reference).alias("c")).agg(*[F.coalesce(F.sum(f"c.{x}"), F.lit(0)).alias(x) for x in names])

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        return pd.Series([bleu_of(dict(zip(names, row)), order) for row in zip(*cols)])

    return sums.select(*names, score(*names).alias("bleu"))


def _stem(w: str) -> str:
    for end in ("ational", "iness", "ingly", "edly", "ing", "ied", "ies", "ed", "es", "ly", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def meteor(prediction: str, reference: str, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """Unigram matches, exact before stemmed, weighed F-mean with a penalty for chunks; no synonyms are consulted."""
    p, r = prediction.lower().split(), reference.lower().split()
    used, match = set(), {}
    for f in (lambda w: w, _stem):
        where: dict[str, list[int]] = {}
        for j, w in enumerate(r):
            if j not in used:
                where.setdefault(f(w), []).append(j)
        for i, w in enumerate(p):
            if i not in match and where.get(f(w)):
                after = [j for j in where[f(w)] if i - 1 in match and j == match[i - 1] + 1]
                j = after[0] if after else where[f(w)][0]
                where[f(w)].remove(j)
                match[i] = j
                used.add(j)
    m = len(match)
    if not m:
        return 0.0
    precision, recall = m / len(p), m / len(r)
    order = sorted(match)
    chunks = 1 + sum(not (b == a + 1 and match[b] == match[a] + 1) for a, b in zip(order, order[1:]))
    return precision * recall / (alpha * precision + (1 - alpha) * recall) * (1 - gamma * (chunks / m) ** beta)


def rouge_l(prediction: str, reference: str) -> float:
    """F-measure of the longest common subsequence of words."""
    p, r = prediction.lower().split(), reference.lower().split()
    row = [0] * (len(r) + 1)
    for w in p:
        last = 0
        for j, v in enumerate(r, 1):
            last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
    n = row[-1]
    return 2 * n / (len(p) + len(r)) if n else 0.0


def pair_score(f):
    """A row score of two texts as an Arrow-batched column function."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b)])

    return run
