"""Deduplication, sampling, splitting, sharding and ranking of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import numbered, summed_before


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order.

    min-by aggregates map-side, so a key with a third of all rows costs a row per task; a window would sort it whole.
    """
    values = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    return best.select(*keys, *[F.col("_first")[c].alias(c) for c in values])


def union_first(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union in order of priority, the first row of each key kept."""
    out = None
    for i, f in enumerate(frames):
        ranked = f.withColumn("_source", F.lit(i))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    return first_wins(out, keys, ["_source", *order]).drop("_source")


def last_per_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """Later rows replace earlier ones of the same key."""
    values = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*values), position).alias("_last")).select(key, *[F.col("_last")[c].alias(c) for c in values])


def hashed(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 1337) -> DataFrame:
    """n rows by the smallest hash: a distributed top-n."""
    return df.orderBy(hashed(key, seed), F.col(key)).limit(n)


def split_exact(df: DataFrame, key: str, valid: int = 100, seed: int = 1337) -> DataFrame:
    """Adds split: exactly min(valid, rows) rows are 'valid', the rest 'train'. The chosen keys are few and bounded by valid."""
    chosen = sample_exact(df.select(key).distinct(), key, valid, seed).withColumn("_valid", F.lit(True))
    return df.join(chosen, key, "left").withColumn("split", F.when(F.col("_valid"), "valid").otherwise("train")).drop("_valid")


def split_share(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds split: by hash, 'train' for about share of the keys; needs no shuffle. split_share_exact gives the exact number."""
    u = F.conv(F.substring(hashed(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(u < share, "train").otherwise("valid"))


def split_share_exact(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds split: exactly ceil((1 - share) * rows) rows, the first by hash, are 'valid', the rest 'train'. Rows are
    numbered over range partitions, so neither part goes through one task; equal keys are told apart by their number."""
    placed = numbered(df.withColumn("_h", hashed(key, seed)), ["_h", key], "_at")
    size = placed.agg(F.ceil(F.round(F.count("*") * (1 - share), 6)).alias("_valid"))
    return placed.crossJoin(F.broadcast(size)).withColumn("split", F.when(F.col("_at") < F.col("_valid"), "valid").otherwise("train")).drop("_h", "_at", "_valid")


def clamp(value: Column, least: float | None = None, most: float | None = None) -> Column:
    """value within bounds; null and NaN stay as they are."""
    low = value if least is None else F.when(value < least, F.lit(least)).otherwise(value)
    return low if most is None else F.when((low > most) & ~F.isnan(low.cast("double")), F.lit(most)).otherwise(low)


def with_least_rows(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of the groups that have at least so many rows; a null group counts as one group."""
    big = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return df.join(big, F.col(group).eqNullSafe(F.col("_g")), "left_semi")


def choose(options: list[str], key: Column) -> Column:
    """One option a row, by md5 of the key."""
    at = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % len(options)
    return F.element_at(F.array(*[F.lit(o) for o in options]), (at + 1).cast("int"))


def sharded(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds position, shard and place: size rows a shard in a total order, numbered without a single task."""
    out = numbered(df, order, "position")
    return out.withColumn("shard", F.floor(F.col("position") / size)).withColumn("place", F.col("position") % size)


def shard_sizes(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("rows"))


def islands(df: DataFrame, number: str, by: list[str]) -> DataFrame:
    """Runs of consecutive whole numbers within each group: first, last, count."""
    w = Window.partitionBy(*by).orderBy(number)
    keyed = df.select(*by, number).distinct().withColumn("_island", F.col(number) - F.row_number().over(w))
    return keyed.groupBy(*by, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_island")


def shard_patterns(names: DataFrame, column: str = "name", skip_last: bool = False) -> DataFrame:
    """Brace patterns of numbered shard files, by prefix, digit width and extension; empty if nothing is left."""
    form = r"\A(.*?)(\d+)(\.\w+)\z"
    part = names.select(F.regexp_extract(column, form, 1).alias("prefix"), F.regexp_extract(column, form, 2).alias("digits"), F.regexp_extract(column, form, 3).alias("ext")).filter("digits <> ''")
    part = part.select("prefix", "ext", F.length("digits").alias("width"), F.col("digits").cast("bigint").alias("number"))
    if skip_last:
        part = part.crossJoin(F.broadcast(part.agg(F.max("number").alias("_top")))).filter("number < _top").drop("_top")
    runs = islands(part, "number", ["prefix", "ext", "width"])
    pad = lambda c: F.lpad(F.col(c).cast("string"), F.col("width"), F.lit("0"))
    body = F.when(F.col("first") == F.col("last"), pad("first")).otherwise(F.concat(F.lit("{"), pad("first"), F.lit(".."), pad("last"), F.lit("}")))
    return runs.select(F.concat("prefix", body, "ext").alias("pattern"), "n")


def renumbered(df: DataFrame, order: list[str], width: int = 6, ext: str = ".tar") -> DataFrame:
    """Adds new_name: files of several folders in one sequence."""
    return numbered(df, order, "number").withColumn("new_name", F.concat(F.lpad(F.col("number").cast("string"), width, "0"), F.lit(ext)))


def file_offsets(files: DataFrame, order: str, size: str) -> DataFrame:
    """Adds offset: the rows before each file, by running sums over range partitions."""
    return summed_before(files, [order], size, "offset")


def repeat_sampler(df: DataFrame, order: list[str], batch: int, mini: int, repeats: int) -> DataFrame:
    """Rows in an order, cut into chunks of batch rows, a short last chunk dropped; each row mini times in place, each
    chunk repeats times. Adds chunk, pass, place and copy, which give the order."""
    placed = numbered(df, order, "_at")
    whole = placed.agg(F.floor(F.count("*") / batch).alias("_chunks"))
    chunked = placed.withColumn("chunk", F.floor(F.col("_at") / batch)).crossJoin(F.broadcast(whole)).filter("chunk < _chunks")
    spread = chunked.withColumn("place", F.col("_at") % batch).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(mini - 1))))
    return spread.drop("_at", "_chunks")


def every_nth(df: DataFrame, position: str, n: int) -> DataFrame:
    return df.filter(F.pmod(F.col(position), F.lit(n)) == 0)


def top_per_group(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group; the window is pushed down as a group limit before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def balanced_sample(df: DataFrame, group: str, key: str, per_group: int, seed: int = 7) -> DataFrame:
    """Up to per_group rows of each group by hash, so that rare groups weigh as much as frequent ones."""
    return top_per_group(df.withColumn("_h", hashed(key, seed)), group, "_h", key, per_group).drop("_h", "rank")


def inverted_index(df: DataFrame, key: str, tags: str) -> DataFrame:
    """(tag, keys): one row per tag."""
    return df.select(key, F.explode(tags).alias("tag")).groupBy("tag").agg(F.sort_array(F.collect_set(key)).alias("keys"))
