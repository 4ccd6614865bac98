"""Connected components by alternating large and small stars, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of a link and the smallest node of its component, in the order of the type.

    Links with a null end are ignored; self links only name a node; repeated links count once. Each round is two
    aggregations and two joins over the links, and about log2 of the longest chain rounds are needed; a node with very
    many links is combined map-side, and its join is one row against many, which adaptive execution splits.
    """
    pairs = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = cut(pairs.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        down = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    nodes = pairs.select(F.explode(F.array(a, b)).alias("node")).distinct()
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
