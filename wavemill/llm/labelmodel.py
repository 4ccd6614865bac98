"""Weak supervision: labelling functions vote +1 (case), -1 (no case) or 0 (abstain); EM weighs them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(votes: np.ndarray, counts: np.ndarray, prior: float = 0.05, rounds: int = 60, anchors: dict[int, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and the (2, functions) accuracies on cases and on the rest.

    votes: patterns x functions; counts: how many records show each. An abstention says nothing. Accuracies stay
    above chance, so the two classes can't change places; pseudo-counts keep rare functions near their start of 0.9.
    anchors: functions whose accuracy is known, as they measure what a case is defined by; the others are measured by them.
    """
    votes, counts = np.asarray(votes, float), np.asarray(counts, float)
    acc, share = np.full((2, votes.shape[1]), 0.9), prior
    yes, no, post = votes > 0, votes < 0, np.zeros(len(votes))
    for j, a in (anchors or {}).items():
        acc[:, j] = a
    for _ in range(rounds):
        log_case = np.log(share) + yes @ np.log(acc[0]) + no @ np.log(1 - acc[0])
        log_rest = np.log(1 - share) + no @ np.log(acc[1]) + yes @ np.log(1 - acc[1])
        post = 1 / (1 + np.exp(np.clip(log_rest - log_case, -700, 700)))
        case, rest = counts * post, counts * (1 - post)
        share = float(np.clip((case.sum() + 1) / (counts.sum() + 20), 1e-4, 0.5))
        acc[0] = np.clip((case @ yes + 9) / (case @ yes + case @ no + 10), 0.6, 0.995)
        acc[1] = np.clip((rest @ no + 9) / (rest @ yes + rest @ no + 10), 0.6, 0.9995)
        for j, a in (anchors or {}).items():
            acc[:, j] = a
    return post, acc


def posteriors(df: DataFrame, functions: list[str], prior: float = 0.05, anchors: dict[str, float] | None = None) -> DataFrame:
    """Adds posterior to df, whose columns functions hold the votes.

    The model sees only how often each vote pattern occurs over all rows: at most 3 ** len(functions) rows, which is
    also the size of the table that is joined back by broadcast.
    """
    spark = df.sparkSession
    seen = df.groupBy(*functions).count().collect()
    schema = ", ".join(f"`{f}` int" for f in functions) + ", posterior double"
    if not seen:
        return df.withColumn("posterior", F.lit(None).cast("double"))
    votes = np.array([[int(r[f]) for f in functions] for r in seen])
    post, _ = fit(votes, np.array([r["count"] for r in seen]), prior, anchors={functions.index(k): a for k, a in (anchors or {}).items()})
    table = spark.createDataFrame([(*map(int, v), float(p)) for v, p in zip(votes, post)], schema)
    return df.join(F.broadcast(table), functions)
