"""Outliers by mean cosine dissimilarity to a reference set."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, unit


def pairwise(probe: DataFrame, reference: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Mean of 1 - cosine over all pairs, by comparing all pairs. Quadratic: kept to check mean_dissimilarity on small
    inputs only."""
    p = probe.select(key, unit(F.col(vector)).alias("_p")).filter("_p is not null")
    r = reference.select(unit(F.col(vector)).alias("_r")).filter("_r is not null")
    return p.crossJoin(r).groupBy(key).agg(F.avg(1 - dot(F.col("_p"), F.col("_r"))).alias("dissimilarity"))


def mean_dissimilarity(probe: DataFrame, reference: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The same mean by linearity: 1 - unit(p) . mean(unit(r)). One aggregation to a single centroid row instead of all
    pairs. Vectors of norm 0 or NaN take no part on either side."""
    r = reference.select(F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    centroid = r.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("_c"))
    p = probe.select(key, *(keep or []), unit(F.col(vector)).alias("_u")).filter("_u is not null")
    return p.crossJoin(F.broadcast(centroid)).select(key, *(keep or []), (1 - dot(F.col("_u"), F.col("_c"))).alias("dissimilarity"))


def batch_mean_dissimilarity(probe: DataFrame, reference: DataFrame, batch_size: int, order: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The variant that averages per-batch means with equal weight, so that a short last batch weighs more."""
    from .joins import numbered

    r = numbered(reference, [order], "_n").select(F.floor(F.col("_n") / batch_size).alias("_b"), F.posexplode(unit(F.col(vector))).alias("i", "x"))
    per = r.groupBy("_b", "i").agg(F.avg("x").alias("x")).groupBy("i").agg(F.avg("x").alias("x"))
    centroid = per.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("_c"))
    p = probe.select(key, unit(F.col(vector)).alias("_u")).filter("_u is not null")
    return p.crossJoin(F.broadcast(centroid)).select(key, (1 - dot(F.col("_u"), F.col("_c"))).alias("dissimilarity"))


def above(df: DataFrame, threshold: float, column: str = "dissimilarity") -> DataFrame:
    """Rows over the threshold; NaN never passes."""
    return df.filter(~F.isnan(column) & (F.col(column) > threshold))


def report(df: DataFrame, threshold: float, group: str = "label") -> DataFrame:
    """Per group: rows, rows over the threshold, their percentage of all such rows, and mean, largest, smallest value."""
    over = above(df, threshold)
    per = over.groupBy(group).agg(F.count("*").alias("outliers"), F.avg("dissimilarity").alias("mean"), F.max("dissimilarity").alias("largest"), F.min("dissimilarity").alias("smallest"))
    return per.crossJoin(F.broadcast(over.agg(F.count("*").alias("_all")))).withColumn("percent", F.col("outliers") * 100.0 / F.col("_all")).drop("_all")


def similar_pairs(df: DataFrame, left: str, right: str, threshold: float = 0.5) -> DataFrame:
    """Rows whose two vectors agree by the threshold."""
    return df.withColumn("similarity", cosine(F.col(left), F.col(right))).filter(~F.isnan("similarity") & (F.col("similarity") >= threshold))


def codebook(df: DataFrame, k: int, vector: str = "embedding", seed: int = 1) -> DataFrame:
    """Adds code: cosine k-means; usage is a count by code."""
    v = df.filter(unit(F.col(vector)).isNotNull()).withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", predictionCol="code", maxIter=10).fit(v)
    return model.transform(v).drop("features")
