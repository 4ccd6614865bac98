"""Tar archives as a source and a sink, with the Python Data Source API: one partition per archive.

Paths are of any file system that pyarrow opens by URI (file, hdfs, s3, gs); a path without a scheme is local.
"""

from __future__ import annotations

import fnmatch
import io
import json
import posixpath
import tarfile
import time
import uuid
from collections.abc import Collection, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "archive string, position int, name string, stem string, ext string, size bigint, content binary"


@dataclass
class Archive(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


def system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    uri = urlparse(path)
    if uri.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(uri.path) if uri.scheme else path
    return fs.FileSystem.from_uri(path)


def _files(path: str, settled: float = 0.0) -> list[str]:
    """Archives of a file, a folder, or a pattern, in order; those changed in the last settled seconds are left out."""
    place, at = system(path)
    if any(x in at for x in "*?["):
        head = at[: min(at.index(x) for x in "*?[" if x in at)].rpartition("/")[0]
        pattern = at
    else:
        info = place.get_file_info(at)
        if info.type == fs.FileType.File:
            return [] if posixpath.basename(at).startswith(("_", ".")) else [path]
        head, pattern = at, posixpath.join(at, "*.tar*")
    found = place.get_file_info(fs.FileSelector(head or ".", recursive=True, allow_not_found=True))
    ready = time.time() - settled
    names = [i.path for i in found if i.is_file and fnmatch.fnmatch(i.path, pattern) and not i.base_name.startswith(("_", ".")) and (not settled or i.mtime_ns is None or i.mtime_ns / 1e9 <= ready)]
    start = path[: -len(at)] if path.endswith(at) else ""
    return sorted(start + n for n in names)


def members(path: str, only: Collection[str] = ()) -> Iterator[tuple]:
    """Rows of one archive, compressed or not; links and folders are passed over. Of an uncompressed archive the contents
    that aren't wanted are skipped by seeking, not read."""
    place, at = system(path)
    with place.open_input_file(at) as raw:
        packed = raw.read(6).startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ", b"\x28\xb5\x2f\xfd"))
        raw.seek(0)
        with tarfile.open(fileobj=raw, mode="r|*" if packed else "r:") as t:
            n = 0
            for m in t:
                if not m.isfile():
                    continue
                if not only or m.name in only:
                    base = posixpath.basename(m.name)
                    stem, dot, ext = base.partition(".") if " (" not in base else base.rpartition(".")
                    if not dot:
                        stem, ext = base, ""
                    yield (path, n, m.name, stem, ext, m.size, t.extractfile(m).read())
                n += 1


class TarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.archives, self.members = options.get("path", ""), set(json.loads(options.get("archives", "[]"))), frozenset(json.loads(options.get("members", "[]")))

    def partitions(self):
        return [Archive(p) for p in _files(self.path) if not self.archives or posixpath.basename(p) in self.archives] or [Archive("")]

    def read(self, partition: Archive):
        if partition.path:
            yield from members(partition.path, self.members)


class TarStream(DataSourceStreamReader):
    """Archives that appear in a folder, each once, whatever its name and time.

    The offset holds the names read so far, as an archive may sort, and be dated, before others that were read. It grows
    by a name an archive; archives hold thousands of members. Those changed in the last settled seconds wait.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.settled = options.get("path", ""), float(options.get("settled", "0"))

    def initialOffset(self):
        return {"seen": []}

    def latestOffset(self):
        return {"seen": _files(self.path, self.settled)}

    def partitions(self, start, end):
        seen = set(start["seen"])
        return [Archive(p) for p in end["seen"] if p not in seen]

    def read(self, partition: Archive):
        yield from members(partition.path)


class TarWriter(DataSourceWriter):
    """Writes rows (shard, name, content) into one archive per shard of each task, renamed into place on commit."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex[:8]

    def write(self, iterator) -> Written:
        place, base = system(self.path)
        place.create_dir(base, recursive=True)
        open_shard, tar, sink, paths = None, None, None, []
        for row in iterator:
            if tar is None or row.shard != open_shard:
                if tar is not None:
                    tar.close()
                    sink.close()
                open_shard = row.shard
                part = posixpath.join(base, f".{int(open_shard):06d}.tar.{self.run}-{uuid.uuid4().hex[:6]}")
                paths.append(part)
                sink = place.open_output_stream(part)
                tar = tarfile.open(fileobj=sink, mode="w|")
            content = bytes(row.content or b"")
            info = tarfile.TarInfo(row.name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
        if tar is not None:
            tar.close()
            sink.close()
        return Written(paths)

    def commit(self, messages):
        place, base = system(self.path)
        if self.overwrite:
            for old in _files(self.path):
                place.delete_file(system(old)[1])
        for m in messages:
            for p in m.paths if m else []:
                place.move(p, posixpath.join(base, posixpath.basename(p)[1:].split(".tar.")[0] + ".tar"))

    def abort(self, messages):
        place, _ = system(self.path)
        for m in messages:
            for p in m.paths if m else []:
                if place.get_file_info(p).type == fs.FileType.File:
                    place.delete_file(p)


class TarSource(DataSource):
    """format("tar"): option path is a file, a folder or a pattern; archives and members, if given, are JSON lists of the
    files to open and of the members to read."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(self.options)

    def streamReader(self, schema: StructType) -> TarStream:
        return TarStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TarWriter:
        return TarWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarSource)


def read(spark: SparkSession, path: str, archives: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """All archives of a path, or only those named, the rest isn't opened; of these all members, or only those named."""
    register(spark)
    return spark.read.format("tar").option("archives", json.dumps(archives or [])).option("members", json.dumps(names or [])).load(path)


def members_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(archive, name, content) of the members listed in wanted (archive, name): each archive is opened once, by one task,
    and only what is wanted of it is read. archive is a path below path; a list per archive is held by its task."""
    lists = wanted.groupBy("archive").agg(F.collect_set("name").alias("names"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for archive, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in members(f"{path.rstrip('/')}/{archive}", frozenset(names)):
                    yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([row[2]]), pa.array([row[6]], pa.binary())], ["archive", "name", "content"])

    return lists.mapInArrow(run, "archive string, name string, content binary")


def write(df: DataFrame, path: str, shard: str = "shard", name: str = "name", content: str = "content") -> None:
    """One archive per shard; all rows of a shard go to one task, in order of their names."""
    register(df.sparkSession)
    rows = df.select(F.col(shard).alias("shard"), F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    rows.repartition("shard").sortWithinPartitions("shard", "name").write.format("tar").mode("overwrite").save(path)


def rename_members(df: DataFrame) -> DataFrame:
    """Members with the dots of their times written as underscores, shard by archive: to be written to a new folder."""
    from ..functions.keys import clean_member

    fixed = F.concat(clean_member(F.col("stem")), F.when(F.col("ext") != "", F.concat(F.lit("."), "ext")).otherwise(""))
    return df.select(F.regexp_extract("archive", r"(\d+)\.tar", 1).cast("int").alias("shard"), fixed.alias("name"), "content")


def counts(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Members of each kind per archive, and whether all kinds are equally many and nothing else is there."""
    per = df.groupBy("archive").agg(*[F.count_if(F.col("ext") == k).alias(k) for k in kinds], F.count("*").alias("total"))
    same = F.lit(True)
    for k in kinds:
        same = same & (F.col(k) * len(kinds) == F.col("total"))
    return per.withColumn("complete", same)


def rewrite(df: DataFrame, path: str) -> None:
    """Writes archives (shard, name, content) over those of the same shard in path, which may be what df was read from: the
    new ones are complete before any is moved into place, one by one; other archives stay."""
    place, base = system(path)
    aside = f"{path.rstrip('/')}/_new-{uuid.uuid4().hex[:8]}"
    write(df, aside)
    for p in _files(aside):
        at = system(p)[1]
        place.move(at, posixpath.join(base, posixpath.basename(at)))
    place.delete_dir(system(aside)[1])
