"""Problem 8: mixing sources to target weights by blocks, multinomial shard counts and index permutations."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import FILE, TOKENIZER_DIR, encoder
from .common import cut, first_per_key, mix64, spread

BLOCK_TOKENS = 512
SHARD_TOKENS = 1 << 17
#: The plan that the driver draws has at most so many rows, each of a bundle of shards, which tasks draw further.
BUNDLES = 4096
SLICE = 1024


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of range(size): a four-round Feistel network, walked until it falls within the range."""
    bits = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << bits) - 1)
    x, out = index.astype(np.uint64), np.zeros(len(index), np.int64)
    todo = np.arange(len(index))
    while len(todo):
        left, right = x >> np.uint64(bits), x & low
        for r in range(4):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
            left, right = right, left ^ (mix64(right + salt) & low)
        x = (left << np.uint64(bits)) | right
        inside = x < size
        out[todo[inside]] = x[inside].astype(np.int64)
        x, todo = x[~inside], todo[~inside]
    return out


def sizes_in_tokens(docs: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, file: str = FILE) -> DataFrame:
    """(doc_id, source, n_tokens): one row per record that has tokens; of repeated rows the last loaded counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_dir, file)
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                n = pa.array(bpe.count_batch(b.column(3).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n], ["doc_id", "source", "loaded_at", "n_tokens"])

    counted = spread(docs.select("doc_id", "source", "loaded_at", "text"), "doc_id", "loaded_at").mapInArrow(run, "doc_id bigint, source string, loaded_at timestamp, n_tokens bigint")
    return first_per_key(counted, ["doc_id"], ["source", "n_tokens"], "loaded_at").filter("n_tokens > 0")


def blocks_of(sized: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 11) -> DataFrame:
    """(source, block, doc_id, start, n_tokens): the records of a source, in hashed order, laid end to end and cut every
    block_tokens tokens. Every block but a source's last is full; a record is as many pieces as blocks it lies in.

    The running sum is taken in order within range partitions and shifted by the sums of those before. A range partition
    holds one source or a few, so at most partitions + sources sums are broadcast, and no source goes through one task.
    """
    spark = sized.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for b in batches:
            source, n = b.column(1).to_pylist(), b.column(2).to_numpy()
            here = np.empty(len(n), np.int64)
            for i, (s, k) in enumerate(zip(source, n.tolist())):
                if s != last:
                    last, total = s, 0
                here[i] = total
                total += k
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(3), pa.array(here)], ["doc_id", "source", "n_tokens", "_part", "_here"])

    keyed = sized.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    ranged = keyed.repartitionByRange(parts, "source", "_h", "doc_id").sortWithinPartitions("source", "_h", "doc_id")
    laid = cut(ranged.select("doc_id", "source", "n_tokens", F.spark_partition_id().alias("_part")).mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, _part int, _here bigint"))
    sums = laid.groupBy("source", "_part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    at = laid.join(F.broadcast(shift), ["source", "_part"]).withColumn("_at", F.col("_here") + F.col("_shift"))
    number = lambda x: F.floor(x / block_tokens)
    each = at.select("source", "doc_id", "n_tokens", "_at", F.explode(F.sequence(number(F.col("_at")), number(F.col("_at") + F.col("n_tokens") - 1))).alias("block"))
    start = F.greatest(F.col("block") * block_tokens - F.col("_at"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_tokens - F.col("_at"), "n_tokens")
    return each.select("source", "block", "doc_id", start.alias("start"), (end - start).alias("n_tokens"))


def _draw(rng: np.random.Generator, left: np.ndarray, size: int) -> np.ndarray:
    """How many of size draws without replacement fall on each source; from a great many, with replacement as well."""
    if not size:
        return np.zeros_like(left)
    if left.sum() < 10**9:
        return rng.multivariate_hypergeometric(left, size, method="marginals")
    drawn = np.minimum(rng.multinomial(size, left / left.sum()), left)
    for i in np.argsort(drawn - left):
        drawn[i] += min(left[i] - drawn[i], size - drawn.sum())
    return drawn


def draw_plan(have: dict[str, tuple[int, int]], targets: list[tuple[str, float, int]], block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = 11):
    """Rows (bundle, first shard, shards, [source], [first slot], [slots], [blocks of the source]) of the mixture.

    have: tokens and blocks by source. The mixture is as large as the scarcest source allows at its target share and
    cap; absent sources leave their share to the others in proportion. Slots per source over all shards are fixed by the
    shares; each shard draws its counts at random from what remains: multinomial counts given these totals.
    """
    present = [(s, w, r) for s, w, r in targets if w and w > 0 and r and r > 0 and have.get(s, (0, 0))[0] > 0]
    if not present:
        return []
    whole = sum(w for _, w, _ in present)
    total = min(r * have[s][0] * whole / w for s, w, r in present)
    slots = np.array([min(r * have[s][1], int(round(total * w / whole / block_tokens))) for s, w, r in present], np.int64)
    shards = max(1, -(-int(slots.sum()) * block_tokens // shard_tokens))
    bundles = min(BUNDLES, shards)
    rng, rows, left, done = np.random.default_rng(seed), [], slots.copy(), np.zeros(len(slots), np.int64)
    for k in range(bundles):
        a, b = shards * k // bundles, shards * (k + 1) // bundles
        drawn = _draw(rng, left, int(left.sum() * (b - a) // (shards - a)))
        rows.append((k, a, b - a, [s for s, _, _ in present], done.tolist(), drawn.tolist(), [have[s][1] for s, _, _ in present]))
        left, done = left - drawn, done + drawn
    return rows


def _source_key(name: str, seed: int) -> int:
    return int.from_bytes(blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")


def mix(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = 11, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """The mixture: one row per use of a piece of a record: shard, slot, source, block, use_no (1, 2, ..), doc_id, start,
    n_tokens. A slot of a source is one block of block_tokens tokens; every block is used max_repeats times at most.

    Records of null source or of sources without target, and records without tokens (null or empty texts) take no
    part; a target whose source has no records reaches share 0. targets is a settings table (a row per source).
    """
    spark = docs.sparkSession
    want = [(r.source, r.target_share, r.max_repeats) for r in targets.orderBy("source").collect() if r.source is not None]
    taken = docs.filter(F.col("source").isin([s for s, _, _ in want])) if want else docs.limit(0)
    blocks = cut(blocks_of(sizes_in_tokens(taken, tokenizer_dir), block_tokens, seed))
    have = {r.source: (r.t, r.b + 1) for r in blocks.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("block").alias("b")).collect()}
    plan = draw_plan(have, want, block_tokens, shard_tokens, seed)
    schema = "bundle int, first_shard bigint, shards bigint, source array<string>, first array<bigint>, slots array<bigint>, blocks array<bigint>"
    bundles = spark.createDataFrame(plan, schema).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bundle")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bundle, first_shard, shards, source, first, slots, size in zip(*(c.to_pylist() for c in b.columns)):
                rng, left, at = np.random.default_rng([seed, bundle]), np.array(slots, np.int64), np.array(first, np.int64)
                for k in range(shards):
                    drawn = _draw(rng, left, int(left.sum() // (shards - k)))
                    for name, begin, n, whole in zip(source, at.tolist(), drawn.tolist(), size):
                        slot = np.arange(begin, begin + n)
                        for use in np.unique(slot // whole).tolist():
                            mine = slot[slot // whole == use]
                            block = permute(mine % whole, whole, _source_key(name, seed) ^ use)
                            fixed = [pa.array([x] * len(mine), t) for x, t in ((first_shard + k, pa.int64()), (name, pa.string()))]
                            yield pa.RecordBatch.from_arrays([*fixed, pa.array(mine), pa.array(np.full(len(mine), use + 1)), pa.array(block)], ["shard", "source", "slot", "use_no", "block"])
                    left, at = left - drawn, at + drawn

    placed = bundles.mapInArrow(run, "shard bigint, source string, slot bigint, use_no bigint, block bigint")
    return placed.join(blocks, ["source", "block"]).select("shard", "slot", "source", "block", "use_no", "doc_id", "start", "n_tokens")


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: tokens of the mixture, share reached, and the most often any record was used."""
    uses = mixture.groupBy("source", "doc_id", "start").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("n"))
    records = uses.groupBy("source", "doc_id").agg(F.sum("n").alias("n"), F.max("uses").alias("uses"))
    per = records.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    whole = per.agg(F.sum("tokens").alias("all_tokens"))
    return (
        targets.join(per, "source", "left").join(F.broadcast(whole), F.lit(True), "left")
        .select("source", "target_share", "max_repeats", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
                F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("share_reached"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    )
