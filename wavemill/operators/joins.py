"""Joins beyond a plain equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among the finished ones; null keys are never finished. A null-safe resume."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def not_done_by(df: DataFrame, done: DataFrame, exprs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """As not_done, on expressions: name -> (expression over df, expression over done), such as rounded times."""
    d = done.select(*[r.alias(f"_{k}") for k, (_, r) in exprs.items()]).distinct()
    left = df.select("*", *[x.alias(f"_l_{k}") for k, (x, _) in exprs.items()])
    on = [F.col(f"_l_{k}") == F.col(f"_{k}") for k in exprs]
    return left.join(d, on, "left_anti").drop(*[f"_l_{k}" for k in exprs])


def positional(left: DataFrame, left_order: list, right: DataFrame, index: str) -> DataFrame:
    """Joins the n-th row of left (from 0, in a total order) to the row of right whose index is n.

    A global row number would go through one task; ranks are counted per range partition and shifted instead.
    """
    return numbered(left, left_order, index).join(right, index)


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """df in a total order over range partitions, written once, with _part and _row, which rises within a partition.

    Numbers need two passes over one and the same partitioning: borders are drawn from a sample, so a second exchange,
    of other columns, would put them elsewhere.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    return cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))


def _before(parts: DataFrame, size: Column) -> DataFrame:
    """(_part, _first, _shift): what size adds up to over the partitions before each; a row per partition."""
    per = parts.groupBy("_part").agg(size.alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))


def numbered(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Adds a row number from 0 by a total order without a single-task sort: range partitions, written, counted, shifted."""
    rows = _ranged(df, order)
    shift = F.broadcast(_before(rows, F.count("*")))
    return rows.join(shift, "_part").withColumn(name, F.col("_row") - F.col("_first") + F.col("_shift")).drop("_part", "_row", "_first", "_shift")


def summed_before(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Adds the sum of value over all rows before, by a total order; nulls count as 0. As numbered, without one task for all."""
    rows = _ranged(df, order)
    shift = F.broadcast(_before(rows, F.sum(value)).drop("_first"))
    here = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0)))
    return local.join(shift, "_part").withColumn(name, F.col("_here") + F.col("_shift")).drop("_part", "_row", "_here", "_shift")


def band_first(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, width: float, order: list[str], left_id: list[str]) -> DataFrame:
    """For each left row the first right row, by order, of equal key within +-width; left rows without one are dropped.

    Both sides are cut into cells of the width; a left row looks into its own and the two next cells, so a hot key is
    spread over its cells and no key is compared as a whole.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    l = left.withColumn("_cell", F.explode(F.array(cell(left_at) - 1, cell(left_at), cell(left_at) + 1)))  # noqa: E741
    r = right.withColumn("_cell", cell(right_at))
    near = l.join(r, [key, "_cell"]).filter(F.abs(F.col(left_at) - F.col(right_at)) <= width)
    best = Window.partitionBy(*left_id).orderBy(*order)
    return near.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank", "_cell")


def cascade(left: DataFrame, right: DataFrame, key: str, rules: list, position: str, left_id: list[str]) -> DataFrame:
    """For each left row one right row of equal key: one that meets the first rule, else the second, .., else any; ties
    by position. Adds rule, from 0; left_id must be unique in left, column names distinct, null is never equal.

    A rule is a list of equalities (expression over left, expression over right): an equi-join with the first right row,
    by position, of every combination of key and values, so the work is linear however many rows share a key. A rule that
    is a condition over both sides compares all rows of a key; it is for keys of few rows.
    """
    names = [f.name for f in right.schema if f.name != key]
    ids = list(dict.fromkeys([key, *left_id]))
    found = None
    for i, rule in enumerate([*rules, []]):
        if isinstance(rule, list):
            on = [key, *[f"_k{j}" for j in range(len(rule))]]
            keyed = right.select(key, F.struct(*names).alias("_row"), F.col(position).alias("_at"), *[r.alias(k) for k, (_, r) in zip(on[1:], rule)]).na.drop(subset=on)
            first = keyed.groupBy(*on).agg(F.min_by("_row", "_at").alias("_hit"))
            hits = left.select(*ids, *[l.alias(k) for k, (l, _) in zip(on[1:], rule)]).join(first, on)
        else:
            hits = left.join(right, key).filter(rule).groupBy(*ids).agg(F.min_by(F.struct(*names), position).alias("_hit"))
        hits = hits.select(*left_id, F.struct(F.lit(i).alias("rule"), "_hit").alias("_b"))
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy(*left_id).agg(F.min_by("_b", "_b.rule").alias("_b"))
    return left.join(best, left_id).select(*left.columns, *[F.col("_b._hit")[n].alias(n) for n in names], F.col("_b.rule").alias("rule"))


def total_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails at run time if a left key has no match."""
    marked = left.join(right.withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumn("_hit", F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string")))).otherwise(True)).filter("_hit").drop("_hit")


def outer_then_not_null(frames: list[DataFrame], key: str) -> DataFrame:
    """A chain of full outer joins followed by dropping rows with any null is a chain of inner joins of rows without nulls."""
    out = frames[0].na.drop()
    for f in frames[1:]:
        out = out.join(f.na.drop(), key)
    return out


def stem_pairs(df: DataFrame, stem: str, ext: str, content: str, kinds: list[str]) -> DataFrame:
    """One row per stem with the content of each kind of member as a column; incomplete stems are dropped."""
    wide = df.groupBy(stem).agg(*[F.max(F.when(F.col(ext) == k, F.col(content))).alias(k.lstrip(".")) for k in kinds])
    return wide.na.drop()
