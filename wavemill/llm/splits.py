"""Problem 6: splits that keep related records together, by component swap search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, first_per_key
from .components import components

# The relations that say two ids show the same recording.
SAME = ["reupload", "mirror", "excerpt"]
#: Labels whose shares are kept too: the most frequent ones, the rest count together.
LABELS = 64
#: Components that one task anneals together, chains of each task, steps of a chain, and rounds over all tasks.
BLOCK, CHAINS, STEPS, ROUNDS = 20_000, 4, 1500, 4
LABEL_WEIGHT = 0.2


def bare_id(column: str):
    """The 11-character id in an id or file name written in any of the usual ways; null if there is none."""
    found = F.regexp_extract(F.trim(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")), r"^(?:.*[/=])?([A-Za-z0-9_-]{11})(?:$|[^A-Za-z0-9_-])", 1)
    return F.when(F.length(found) == 11, found)


def recordings(links: DataFrame) -> DataFrame:
    """(node, root): ids tied together by links of the same recording, and the smallest id of each recording."""
    tidy = links.filter(F.col("relation").isin(SAME)).select(bare_id("video_id").alias("a"), bare_id("other_id").alias("b"))
    return components(tidy, "a", "b")


def records(qa: DataFrame, links: DataFrame) -> DataFrame:
    """(qa_id, split, source, recording), one row per record; recording is null if neither id is given.

    Of repeated deliveries the last counts. The join is on ids after one row per record, so a video that holds much
    of the data is a hot key of narrow rows only, on the large side of a join with unique keys.
    """
    named = qa.select("qa_id", "loaded_at", "split", "source", F.when(F.col("video_id").isNotNull(), bare_id("video_id")).otherwise(bare_id("file_name")).alias("node"))
    last = first_per_key(named, ["qa_id"], ["split", "source", "node"], "loaded_at")
    return last.join(recordings(links), "node", "left").select("qa_id", "split", "source", F.coalesce("root", "node").alias("recording"))


def straddling(rows: DataFrame) -> DataFrame:
    """Recordings whose records lie in more than one split; null splits and recordings take no part."""
    pairs = rows.filter("recording is not null and split is not null").select("recording", "split").distinct()
    return pairs.groupBy("recording").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("recording").alias("video_id"))


def deviation(sums: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Cost of split sums (.., splits, 1 + labels) against targets of the same shape, squares scaled by weight."""
    return (((sums - target) ** 2) * weight).sum((-2, -1))


def anneal(vectors: np.ndarray, split: np.ndarray, target: np.ndarray, weight: np.ndarray, seed: int, steps: int = STEPS, width: int = 48) -> np.ndarray:
    """One chain: moves and exchanges whole components between splits, and returns the best assignment met."""
    n, k = len(vectors), len(target)
    rng, split = np.random.default_rng(seed), split.copy()
    sums = np.stack([vectors[split == s].sum(0) for s in range(k)])
    cost = float(deviation(sums, target, weight))
    best, best_split, heat = cost, split.copy(), max(cost, 1e-12) * 0.2
    for step in range(steps if n else 0):
        i, j = rng.integers(0, n, width), rng.integers(0, n, width)
        to = rng.integers(0, k, width)
        swap = rng.random(width) < 0.5
        to = np.where(swap, split[j], to)
        change = np.zeros((width, *sums.shape))
        rows = np.arange(width)
        change[rows, split[i]] -= vectors[i]
        change[rows, to] += vectors[i]
        change[rows[swap], to[swap]] -= vectors[j[swap]]
        change[rows[swap], split[i[swap]]] += vectors[j[swap]]
        costs = deviation(sums + change, target, weight)
        costs[(split[i] == to)] = np.inf
        c = int(np.argmin(costs))
        warm = heat * (1 - step / steps) ** 2
        if costs[c] < cost or (np.isfinite(costs[c]) and warm > 0 and rng.random() < np.exp(-(costs[c] - cost) / warm)):
            old = split[i[c]]
            split[i[c]] = to[c]
            if swap[c]:
                split[j[c]] = old
            sums, cost = sums + change[c], float(costs[c])
            if cost < best:
                best, best_split = cost, split.copy()
    return best_split


def assign(weighted: DataFrame, shares: list[tuple[str, float]], labels: int, seed: int = 23) -> DataFrame:
    """(recording, split) of components (recording, vector) with vector = [records, records by label..].

    Start: hash of the recording. In each round the components are dealt anew to tasks; each task corrects its part of the
    deviation left in all splits by several annealing chains and keeps its best. Only the sums of splits x labels
    come to the driver. The best assignment of all rounds, the start included, is returned.
    """
    k = len(shares)
    share = np.array([w for _, w in shares], float)
    share = share / share.sum()
    edge = np.cumsum(share)
    u = F.pmod(F.xxhash64(F.lit(seed), "recording"), F.lit(1 << 30)) / float(1 << 30)
    first = F.lit(k - 1)
    for s in range(k - 2, -1, -1):
        first = F.when(u < float(edge[s]), s).otherwise(first)
    state = cut(weighted.withColumn("at", first.cast("int")))

    def sums_of(df: DataFrame) -> np.ndarray:
        out = np.zeros((k, labels + 1))
        parts = df.groupBy("at").agg(*[F.sum(F.col("vector")[c]).alias(f"c{c}") for c in range(labels + 1)])
        for r in parts.collect():
            out[r["at"]] = [r[f"c{c}"] for c in range(labels + 1)]
        return out

    count = state.count()
    sums = sums_of(state)
    total = sums.sum(0)
    target = share[:, None] * total[None, :]
    weight = np.where(total > 0, 1 / np.maximum(total, 1) ** 2, 0) * np.r_[1.0, np.full(labels, LABEL_WEIGHT / max(labels, 1))]
    weight = np.repeat(weight[None, :], k, 0)
    best_cost, best = float(deviation(sums, target, weight)), state
    blocks = max(1, -(-count // BLOCK))
    for r in range(ROUNDS if count else 0):
        gap = (target - sums) / blocks

        def run(batches: Iterator[pa.RecordBatch], gap: np.ndarray = gap, r: int = r) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            t = pa.Table.from_batches(held)
            names = t.column(0).to_pylist()
            order = np.argsort(np.array(names, object).astype(str), kind="stable")
            vectors, split = np.array(t.column(1).to_pylist(), float), t.column(2).to_numpy()
            mine = np.stack([vectors[split == s].sum(0) for s in range(k)])
            goal = mine + gap
            v, s0 = vectors[order], split[order]
            tries = [s0] + [anneal(v, s0, goal, weight, seed * 1000 + r * 10 + c) for c in range(CHAINS)]
            cost = [float(deviation(np.stack([v[s == x].sum(0) for x in range(k)]), goal, weight)) for s in tries]
            done = np.empty(len(split), np.int32)
            done[order] = tries[int(np.argmin(cost))]
            yield from pa.table({"recording": t.column(0), "vector": t.column(1), "at": pa.array(done)}).to_batches()

        dealt = state.select("recording", "vector", "at", F.pmod(F.xxhash64(F.lit(r), "recording"), F.lit(blocks)).alias("_block")).repartition(blocks, "_block")
        state = cut(dealt.select("recording", "vector", "at").mapInArrow(run, "recording string, vector array<bigint>, at int"))
        sums = sums_of(state)
        cost = float(deviation(sums, target, weight))
        if cost < best_cost:
            best_cost, best = cost, state
    names = F.create_map(*[F.lit(x) for i, (s, _) in enumerate(shares) for x in (i, s)])
    return best.select("recording", names[F.col("at")].alias("split"))


def grouped_split(rows: DataFrame, targets: DataFrame, label: str = "source") -> DataFrame:
    """(qa_id, recording, split): every record, all of one recording in one split.

    rows: (qa_id, recording, label). A record without recording is a component alone. targets (split, target_share) is a
    settings table; its shares are scaled to sum to 1. The LABELS most frequent labels keep their shares as well, and so do
    the records of all others and of null labels together.
    """
    shares = [(r.split, float(r.target_share)) for r in targets.orderBy("split").collect() if r.split is not None and (r.target_share or 0) > 0]
    if not shares:
        raise ValueError("no split has a positive share")
    keyed = rows.select("qa_id", F.col("recording").alias("_given"), F.coalesce("recording", F.concat(F.lit("record:"), F.col("qa_id").cast("string"))).alias("recording"), F.col(label).alias("_label"))
    common = [r[0] for r in keyed.filter("_label is not null").groupBy("_label").count().orderBy(F.desc("count"), "_label").limit(LABELS).collect()]
    marks = [F.count_if(F.col("_label").eqNullSafe(F.lit(x))) for x in common]
    rest = F.count_if(F.lit(True) if not common else ~F.coalesce(F.col("_label").isin(common), F.lit(False)))
    vectors = keyed.groupBy("recording").agg(F.array(F.count("*"), *marks, rest).alias("vector"))
    placed = assign(vectors, shares, len(common) + 1)
    return keyed.join(placed, "recording").select("qa_id", F.col("_given").alias("recording"), "split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split: target share, records, share reached."""
    per = assigned.groupBy("split").agg(F.count("*").alias("records"))
    whole = per.agg(F.sum("records").alias("_all"))
    return targets.join(per, "split", "left").join(F.broadcast(whole), F.lit(True), "left").select("split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.round(F.coalesce(F.col("records") / F.col("_all"), F.lit(0.0)), 6).alias("share_reached"))
