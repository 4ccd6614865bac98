"""Scores over many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_accuracy(df: DataFrame, correct: Column, dimensions: dict[str, list[str] | None], total_of: str) -> DataFrame:
    """(dimension, label, correct, rows, accuracy): percent correct by each dimension, and a total.

    A dimension with a fixed label list has exactly these labels, 0 where empty; others have the labels seen. The total
    counts the rows whose total_of label is a fixed one; 'overall' counts all. One scan: each row is expanded to its
    labels and aggregated map-side.
    """
    ok = F.coalesce(correct, F.lit(False)).cast("int")
    marks = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("label")) for d in dimensions]
    fixed = dimensions[total_of] or []
    marks += [F.struct(F.lit("total").alias("dimension"), F.when(F.col(total_of).isin(fixed), "total").alias("label")), F.struct(F.lit("overall").alias("dimension"), F.lit("overall").alias("label"))]
    long = df.select(ok.alias("ok"), F.explode(F.array(*marks)).alias("m")).select("ok", "m.*").filter("label is not null")
    per = long.groupBy("dimension", "label").agg(F.sum("ok").alias("correct"), F.count("*").alias("rows"))
    lists = [(d, x) for d, xs in dimensions.items() if xs is not None for x in xs] + [("total", "total"), ("overall", "overall")]
    named = df.sparkSession.createDataFrame(lists, "dimension string, label string")
    listed = [d for d, xs in dimensions.items() if xs is not None]
    full = per.join(F.broadcast(named.withColumn("_fixed", F.lit(True))), ["dimension", "label"], "full_outer").filter(F.col("_fixed") | ~F.col("dimension").isin(listed))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return full.select("dimension", "label", zero("correct").alias("correct"), zero("rows").alias("rows"), F.coalesce(zero("correct") * 100.0 / F.nullif(zero("rows"), F.lit(0)), F.lit(0.0)).alias("accuracy"))


def judge_scores(df: DataFrame, score: Column, parsed: Column, scale: float = 20.0, by: list[str] | None = None) -> DataFrame:
    """Mean score on a scale of 100 (a 0-5 rubric x 20, a binary one x 100) and the share of replies that held a number."""
    return df.groupBy(*(by or [])).agg((F.avg(score) * scale).alias("judge_score"), F.avg(parsed).alias("success_rate"), F.count("*").alias("rows"))


def binary_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Precision, recall, F1 and accuracy; 0 where nothing was predicted or true."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    c = df.agg(n(truth & predicted).alias("tp"), n(~truth & predicted).alias("fp"), n(truth & ~predicted).alias("fn"), n(truth == predicted).alias("hit"), F.count("*").alias("rows"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(F.col("hit"), F.col("rows")).alias("accuracy"))


def retrieval(df: DataFrame, k: int, query: str = "query", target: str = "target", score: str = "score", relevant: str = "relevant") -> DataFrame:
    """Recall at k, mean average precision and mean reciprocal rank over queries; a query without relevant target counts 0.

    Ties are broken by target.
    """
    w = Window.partitionBy(query).orderBy(F.desc(score), target)
    hit = F.col(relevant).cast("int")
    ranked = df.withColumn("_rank", F.row_number().over(w)).withColumn("_hits", F.sum(hit).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = ranked.groupBy(query).agg(
        F.sum(hit).alias("n"), F.sum(F.when(F.col("_rank") <= k, hit).otherwise(0)).alias("top"), F.sum(F.when(F.col(relevant), F.col("_hits") / F.col("_rank")).otherwise(0.0)).alias("precisions"), F.min(F.when(F.col(relevant), F.col("_rank"))).alias("first")
    )
    safe = F.nullif(F.col("n"), F.lit(0))
    zero = F.lit(0.0)
    return per.agg(F.count("*").alias("queries"), F.avg(F.coalesce(F.col("top") / safe, zero)).alias("recall"), F.avg(F.coalesce(F.col("precisions") / safe, zero)).alias("map"), F.avg(F.coalesce(1 / F.col("first"), zero)).alias("mrr"))


def vocabulary_novelty(predicted: DataFrame, training: DataFrame, text: str) -> DataFrame:
    """Words used, share of them that training texts lack, and share of texts that training does not hold."""
    words = lambda d: d.select(F.explode(F.split(F.lower(text), r"\s+")).alias("w")).filter("w <> ''").distinct()
    used = words(predicted)
    new = used.join(words(training), "w", "left_anti")
    texts = predicted.select(F.col(text).alias("t"))
    fresh = texts.join(training.select(F.col(text).alias("t")).distinct(), "t", "left_anti")
    a, b = used.agg(F.count("*").alias("vocabulary")), new.agg(F.count("*").alias("new_words"))
    c, d = texts.agg(F.count("*").alias("texts")), fresh.agg(F.count("*").alias("new_texts"))
    one = a.crossJoin(b).crossJoin(c).crossJoin(d)  # four single rows
    return one.select("vocabulary", (F.col("new_words") / F.col("vocabulary")).alias("vocabulary_novelty"), (F.col("new_texts") / F.col("texts")).alias("caption_novelty"))


def vocabulary_diversity(df: DataFrame, text: str) -> DataFrame:
    """Different words over all words."""
    w = df.select(F.explode(F.split(F.lower(text), r"\s+")).alias("w")).filter("w <> ''").groupBy("w").count()
    return w.agg(F.count("*").alias("vocabulary"), (F.count("*") / F.sum("count")).alias("diversity"))


def length_stats(df: DataFrame, count: Column) -> DataFrame:
    return df.agg(F.avg(count).alias("mean"), F.stddev_pop(count).alias("deviation"))


def group_advantage(df: DataFrame, group: str, reward: str, scale: bool = True, epsilon: float = 1e-4) -> DataFrame:
    """Adds advantage: reward less the mean of its group, over the group's sample deviation + epsilon.

    NaN rewards count as 0. A group of one has no deviation: its advantage is null if scaled, else 0. Group statistics
    are aggregated and joined back, so a hot group is never one window partition.
    """
    r = F.coalesce(F.nanvl(F.col(reward), F.lit(None).cast("double")), F.lit(0.0))
    stats = df.groupBy(group).agg(F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_sd"))
    centered = r - F.col("_mean")
    value = centered / (F.col("_sd") + epsilon) if scale else centered
    return df.join(stats, group).withColumn("advantage", value).drop("_mean", "_sd")


def nan_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, sample deviation, smallest and largest of each column, NaN left out."""
    v = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns}
    return df.agg(*[f(v[c]).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("deviation", F.stddev_samp), ("min", F.min), ("max", F.max))])


def completion_stats(df: DataFrame, length: str, ended: str) -> DataFrame:
    """Mean, smallest and largest completion, share cut off, and the same of those that ended."""
    done = F.when(F.col(ended), F.col(length))
    return df.agg(F.avg(length).alias("mean_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), (1 - F.avg(F.col(ended).cast("int"))).alias("clipped_ratio"), F.avg(done).alias("mean_ended"), F.min(done).alias("min_ended"), F.max(done).alias("max_ended"))


def clipped_surrogate(df: DataFrame, ratio: Column, advantage: Column, mask: Column, low: float = 0.2, high: float = 0.2, kl: Column | None = None, beta: float = 0.0, kind: str = "grpo", sequence: str = "sequence", longest: int = 1) -> DataFrame:
    """Policy loss of token rows, for audits. kind: grpo averages per sequence first, bnpo over all tokens, dr_grpo by a
    fixed length."""
    loss = -F.least(ratio * advantage, F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low)) * advantage)
    if kl is not None:
        loss = loss + beta * kl
    m = mask.cast("double")
    per = df.groupBy(sequence).agg(F.sum(loss * m).alias("s"), F.sum(m).alias("n"))
    if kind == "grpo":
        return per.agg(F.avg(F.col("s") / F.greatest("n", F.lit(1.0))).alias("loss"))
    if kind == "bnpo":
        return per.agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1.0))).alias("loss"))
    if kind == "dr_grpo":
        return per.agg((F.sum("s") / (F.count("*") * float(longest))).alias("loss"))
    raise ValueError(f"unknown kind {kind}")


def mean_scores(df: DataFrame, key: list[str], items: str) -> DataFrame:
    """Mean score of each label (array of struct(label, score)) as an array of structs, by label."""
    long = df.select(*key, F.explode(items).alias("x")).groupBy(*key, F.col("x.label").alias("label")).agg(F.avg("x.score").alias("score"))
    return long.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("label", "score"))).alias("items"))


def running_mean(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_mean", F.avg(value).over(w))


def early_stop(df: DataFrame, by: list[str], order: str, loss: str, tolerance: int) -> DataFrame:
    """The first step of each run at which the best loss has not improved for tolerance steps in a row."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    better = F.col(loss) < F.coalesce(F.min(loss).over(before), F.lit(float("inf")))
    island = df.withColumn("_better", better.cast("int")).withColumn("_island", F.sum("_better").over(upto))
    count = island.withColumn("_bad", F.sum(1 - F.col("_better")).over(Window.partitionBy(*by, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return count.filter(F.col("_bad") >= tolerance).groupBy(*by).agg(F.min(order).alias("stop_at"))
