"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import float_text
from ..functions.text import csv_field


def caption_lines(df: DataFrame) -> DataFrame:
    """Lines of the caption dump: id, start, duration, text, the text quoted only where it holds a comma."""
    return df.select(F.concat_ws(",", "video_id", float_text(F.col("start")), float_text(F.col("duration")), csv_field(F.col("text"))).alias("value"))


def write_caption_dump(df: DataFrame, path: str, mode: str = "append") -> None:
    caption_lines(df).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_chunks(df: DataFrame, path: str, rows: int = 100_000, mode: str = "overwrite") -> None:
    """Parquet files of at most so many rows."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).parquet(path)


def write_ranked(df: DataFrame, path: str, score: str, mode: str = "overwrite") -> None:
    """Sorted by descending score over all files."""
    df.orderBy(F.desc(score)).write.mode(mode).parquet(path)


def write_shards(df: DataFrame, path: str, keys: list[str], mode: str = "overwrite") -> None:
    """One folder per shard (and split); a shard is written by one task."""
    df.repartition(*keys).write.mode(mode).partitionBy(*keys).parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A small table of metrics as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def log_status(df: DataFrame, path: str, status: str) -> None:
    """Appends keys with a status, for a later anti-join."""
    df.withColumn("status", F.lit(status)).write.mode("append").parquet(path)
