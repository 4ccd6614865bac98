"""Queries of the training-data operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import defects, mixing, near, overlap, packing, repetition, splits, tokenize, truncation
from .common import cut, table
from .sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def p1_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_qa(table(spark, sf, "generated_qa"), table(spark, sf, "pack_limits"))


def p1_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p1_pack(spark, sf), table(spark, sf, "pack_limits"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return defects.one_defect(defects.defect_labels(table(spark, sf, "generated_qa")))


def p2_labels(spark: SparkSession, sf: str) -> DataFrame:
    return defects.defect_labels(table(spark, sf, "generated_qa"))


def _repetition(spark: SparkSession, sf: str) -> DataFrame:
    both = repetition.both_kinds(table(spark, sf, "generated_qa"), table(spark, sf, "generated_caption"))
    return repetition.repetition(both, ["kind", "rec_id"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetitive(_repetition(spark, sf)).select("kind", "rec_id")


def p3_share(spark: SparkSession, sf: str) -> DataFrame:
    return _repetition(spark, sf)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return near.question_and_caption_texts(table(spark, sf, "generated_qa"), table(spark, sf, "generated_caption"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.as_pairs(overlap.cross_split(_texts(spark, sf)))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(cut(overlap.cross_split(_texts(spark, sf))))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_duplicates(_texts(spark, sf)).select("kind", "id_low", "id_high")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near.duplicate_groups(_texts(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.straddling(splits.records(table(spark, sf, "generated_qa"), table(spark, sf, "video_links")))


def p6_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut(splits.records(table(spark, sf, "generated_qa"), table(spark, sf, "video_links")))
    return splits.grouped_split(rows, table(spark, sf, "split_targets"))


def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_report(p6_splits(spark, sf), table(spark, sf, "split_targets"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf, "documents"))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.share_report(cut(p8_mixture(spark, sf)), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(table(spark, sf, "documents")).filter("cut").select("doc_id")


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(truncation.truncated(table(spark, sf, "documents")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_pack, p1_fill, p2_found, p2_labels, p3_found, p3_share, p4_found, p4_report, p5_found, p5_groups, p6_found, p6_splits, p6_shares, p7_ids, p8_mixture, p8_shares, p9_found, p9_rates)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
