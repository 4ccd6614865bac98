"""Helpers shared by the training-data operators: words, hashes, checkpoint folder."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, discard, spread  # noqa: F401

#: A word is a maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")
M64 = (1 << 64) - 1


#: ASCII characters as they stand in words: lower-cased, all but letters and digits as spaces.
PLAIN = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}


def words(text: str) -> list[str]:
    """Lower-cased words of a text, in order."""
    return text.translate(PLAIN).split() if text.isascii() else [w.lower() for w in WORD.findall(text)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def not_blank(column):
    """True for a text with anything besides white space; null counts as blank."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).rlike(r"(?U)\S")


def first_per_key(df: DataFrame, key: list[str], values: list[str], order: str) -> DataFrame:
    """One row per key: the values of its last row by order (nulls first, ties by the values themselves).

    Aggregates map-side, so a key that is delivered very often costs one row per task.
    """
    packed = F.struct(F.col(order).isNotNull().alias("_k"), F.col(order).alias("_o"), *values)
    return df.groupBy(*key).agg(F.max(packed).alias("_m")).select(*key, *[F.col("_m")[v].alias(v) for v in values])
