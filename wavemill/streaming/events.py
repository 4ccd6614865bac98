"""Structured Streaming: windows, sessions, per-key state, and resumable file processing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, length: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Count and sum per fixed window, for batch and stream alike; late bounds how long a stream waits."""
    df = df.withWatermark(time, late) if late else df
    return df.groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Sessions of each key: events no further apart than the gap."""
    df = df.withWatermark(time, late) if late else df
    return df.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unique(df: DataFrame, keys: list[str], time: str | None = None, late: str | None = None) -> DataFrame:
    """First row of each key; with a time, state is dropped once a repeat can no longer come."""
    if time and late:
        return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops. Started again with the same checkpoint it takes up only what is new, exactly once."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def parquet_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def flush_batches(df: DataFrame, out: str, checkpoint: str) -> None:
    """Each micro-batch replaces its own folder, so a batch that is run again after a failure leaves no doubles."""

    def flush(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    df.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def smoothed_state(df: DataFrame, key: str, order: str, value: str, keep: float = 0.5) -> DataFrame:
    """Exponential smoothing carried from batch to batch, with state of its own for each key."""

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for b in batches:
            rows = []
            for o, v in sorted(zip(b[order], b[value])):
                last = v if last is None else keep * last + (1 - keep) * v
                rows.append((k[0], o, last))
            if rows:
                yield pd.DataFrame(rows, columns=[key, order, "smoothed"])
        if last is not None:
            state.update((float(last),))

    of = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.groupBy(key).applyInPandasWithState(step, f"`{key}` {of[key]}, `{order}` {of[order]}, smoothed double", "last double", "append", "NoTimeout")
