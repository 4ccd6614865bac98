"""Text, JSON, CSV and lists as relations with explicit schemas."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBTITLES = "video struct<videoid:string>, captions string"
SDH = "video_id string, start double, duration double, text string"
VOCABULARY = "word string"
PAIR = "file_name string, qa_pairs array<struct<question:string,thinking:string,semantic_elements:string,answer:string,choices:map<string,string>>>"


def concatenated_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, object): JSON objects that follow each other in a file and may span lines.

    Objects can't be told apart by line, so a file is read by one task, as a stream: only the object in progress is held.
    """
    from .tar import system

    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                held, n, rows = "", 0, []
                place, at = system(p)
                with io.TextIOWrapper(place.open_input_stream(at), encoding="utf-8") as f:
                    for line in f:
                        held += line
                        if "}" not in line:
                            continue
                        try:
                            value = json.loads(held)
                        except ValueError:
                            continue
                        rows.append((p, n, json.dumps(value, ensure_ascii=False)))
                        held, n = "", n + 1
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["path", "position", "object"])
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["path", "position", "object"])

    return names.mapInArrow(run, "path string, position bigint, object string")


def sdh_captions(objects: DataFrame, column: str = "object", lang: str = "en") -> DataFrame:
    """(video_id, start, duration, text) of subtitle objects in one language; a single subtitle instead of a list is a list of
    one; objects without the nested keys give no rows."""
    one = "struct<t:string,`-start`:string,`-dur`:string>"
    head = objects.select(F.get_json_object(column, "$.video.videoid").alias("video_id"), F.from_json(F.get_json_object(column, "$.captions"), "array<string>").alias("c")).select("video_id", F.explode("c").alias("caption"))
    head = head.filter(F.get_json_object("caption", "$.lang") == lang)
    text = F.get_json_object("caption", "$.subtitles.transcript.text")
    rows = head.select("video_id", F.when(text.startswith("["), F.from_json(text, f"array<{one}>")).otherwise(F.array(F.from_json(text, one))).alias("s")).select("video_id", F.explode("s").alias("s"))
    return rows.filter(F.col("s.t").isNotNull()).select("video_id", F.col("s.`-start`").try_cast("double").alias("start"), F.col("s.`-dur`").try_cast("double").alias("duration"), F.col("s.t").alias("text"))


def csv(spark: SparkSession, path: str, schema: str, header: bool = True, lines: bool = False) -> DataFrame:
    """Quotes double inside quoted fields; short or long lines are kept, missing fields null. lines: a quoted field may hold
    line ends, for which a file can't be split over tasks."""
    return spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').option("multiLine", lines).option("mode", "PERMISSIVE").csv(path)


def jsonl(spark: SparkSession, path: str, schema: str, drop_bad: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if drop_bad else "PERMISSIVE").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one list of items."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size) of the files under a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''")


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(filename, dataset, vector) of Parquet files; the data set is named by the parent folder, the file by its last two parts."""
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_path"))
    parts = F.split("_path", "/")
    return df.withColumn("dataset", F.try_element_at(parts, F.lit(-2))).withColumn("file", F.array_join(F.slice(parts, -2, 2), "/")).drop("_path")
