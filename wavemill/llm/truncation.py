"""Problem 9: texts cut off by field limits, from censored length distributions and the evidence of their endings."""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, exp, log, pi, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, first_per_key, spread
from .endings import SAMPLE, corpus_words, fit, sample_texts

#: A length is a candidate limit of a source if so many values and this share of the source have exactly this length..
SPIKE, SPIKE_SHARE = 4, 0.002
#: .. and at most this share of the source is longer.
BEYOND = 0.02
#: Log-odds from which a text counts as cut: sums of ending evidence and censoring posterior.
CUTOFF = -1.0
#: The censoring posterior speaks with at most this weight, in log-odds.
LIMIT_WEIGHT = 4.0


def censored_lognormal(n: float, s1: float, s2: float, censored: float, limit: float, rounds: int = 60) -> tuple[float, float]:
    """Maximum likelihood mean and deviation of log length from n exact values below the limit (sums of logs and their
    squares) and values known only to reach it, by expectation-maximization."""
    mean = (s1 + censored * log(limit)) / (n + censored)
    var = max((s2 + censored * log(limit) ** 2) / (n + censored) - mean * mean, 1e-4)
    for _ in range(rounds):
        sd = sqrt(var)
        z = (log(limit) - mean) / sd
        tail = max(0.5 * (1 - erf(z / sqrt(2))), 1e-12)
        hazard = exp(-z * z / 2) / sqrt(2 * pi) / tail
        first = mean + sd * hazard
        second = var * (1 + z * hazard - hazard * hazard) + first * first
        mean = (s1 + censored * first) / (n + censored)
        var = max((s2 + censored * second) / (n + censored) - mean * mean, 1e-4)
    return mean, sqrt(var)


def limits_of(lengths: DataFrame) -> list[tuple[str, str, int, float]]:
    """(source, unit, limit, posterior that a value of exactly this length was cut) from (source, unit, length).

    A source has at most 1 / SPIKE_SHARE candidate limits; only these and their sums are collected.
    """
    known = lengths.filter("length > 0").groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    known = cut(known)
    total = known.groupBy(F.col("source").alias("ts"), F.col("unit").alias("tu")).agg(F.sum("n").alias("total"))
    spikes = known.join(total, F.col("source").eqNullSafe(F.col("ts")) & (F.col("unit") == F.col("tu"))).filter(
        (F.col("n") >= SPIKE) & (F.col("n") >= SPIKE_SHARE * F.col("total"))
    ).select(F.col("ts").alias("s"), F.col("tu").alias("u"), F.col("length").alias("limit"), F.col("n").alias("at"), "total")
    log_length = F.log("length")
    sums = known.join(F.broadcast(spikes), F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u"))).groupBy("s", "u", "limit", "at", "total").agg(
        F.sum(F.when(F.col("length") < F.col("limit"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("length") < F.col("limit"), F.col("n") * log_length).otherwise(0.0)).alias("s1"),
        F.sum(F.when(F.col("length") < F.col("limit"), F.col("n") * log_length * log_length).otherwise(0.0)).alias("s2"),
    )
    out = []
    for r in sums.collect():
        above = r.total - r.below - r["at"]
        if above > BEYOND * r.total:
            continue
        mean, sd = censored_lognormal(max(r.below, 1), r.s1, r.s2, r["at"] + above, r.limit)
        z = (log(r.limit) - mean) / sd
        expected = r.total * exp(-z * z / 2) / (sqrt(2 * pi) * sd * r.limit)
        posterior = 1 - min(expected / r["at"], 1.0)
        if posterior > 0.5:
            out.append((r.s, r.u, r.limit, posterior))
    return out


def truncated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", sample: int = SAMPLE, cutoff: float = CUTOFF) -> DataFrame:
    """(key, source, n_chars, at_limit, log_odds, cut): one row per record.

    The weights of the ending model are fitted on at most sample texts; its words are counted over all. Null, empty and blank texts are never cut; a null source is a
    source of its own. at_limit is the censoring posterior if the text's length, in code points or in bytes of UTF-8,
    is a limit of its source, else 0. Of rows with one key the last loaded counts. Texts are judged where they are read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(sample_texts(docs, key, [text], sample), words=corpus_words(docs.select(text))))
    kind = docs.schema[key].dataType.simpleString()
    names = [key, source, "loaded_at", "n_chars", "n_bytes", "evidence"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value.judge
        for b in batches:
            score = [judge(t) if t is not None and t.strip() else None for t in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(score, pa.float64())], names)

    rows = docs.select(key, source, "loaded_at", F.length(text).cast("bigint").alias("n_chars"), F.octet_length(text).cast("bigint").alias("n_bytes"), text)
    judged = spread(rows, key, "loaded_at").mapInArrow(run, f"`{key}` {kind}, `{source}` string, loaded_at timestamp, n_chars bigint, n_bytes bigint, evidence double")
    one = cut(first_per_key(judged, [key], [source, "n_chars", "n_bytes", "evidence"], "loaded_at"))
    both = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length"))))
    lengths = one.filter("evidence is not null").select(F.col(source).alias("source"), both.alias("x")).select("source", "x.*")
    limits = limits_of(lengths)
    at = F.lit(0.0)
    for s, unit, length, posterior in limits:
        hit = F.col(source).eqNullSafe(F.lit(s)) & (F.col("n_chars" if unit == "chars" else "n_bytes") == length)
        at = F.greatest(at, F.when(hit, F.lit(posterior)).otherwise(0.0))
    gain = F.when(F.col("at_limit") > 0, F.least(F.log(F.col("at_limit") / (1 - F.least("at_limit", F.lit(1 - 1e-9)))), F.lit(LIMIT_WEIGHT))).otherwise(0.0)
    out = one.withColumn("at_limit", at).withColumn("log_odds", F.col("evidence") + gain)
    return out.select(key, source, "n_chars", "at_limit", "log_odds", F.coalesce(F.col("log_odds") >= cutoff, F.lit(False)).alias("cut"))


def rates(found: DataFrame, source: str = "source") -> DataFrame:
    """Per source: records with text, records cut, and their share."""
    return found.groupBy(source).agg(F.count("log_odds").alias("texts"), F.count_if("cut").alias("cut_texts")).withColumn("rate", F.round(F.col("cut_texts") / F.greatest("texts", F.lit(1)), 6))
