"""Session settings the engine relies on, the folder that executors share, and tables written there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Bytes on disk of a task of spread.
TASK_BYTES = 16 << 20


def attach(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, paths) if x)
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores before heavy work on each row, where it comes from fewer files than there are cores.

    A file that was written in one piece is read by one task. The number of tasks follows the bytes that are scanned.
    Inputs of more files are left alone; their files are counted in the JVM, no path comes to Python.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())
    if files >= cores:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if files else 0
    return df.repartition(max(cores, -(-size // TASK_BYTES)), *keys)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one machine (a local master) gets a
    temporary folder; a cluster gets an error, as its executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif context.master.split("[")[0] == "local":
            folder = os.path.join(tempfile.gettempdir(), "wavemill-checkpoint")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, kind: str = "q") -> str:
    """The name of a new folder in checkpoint_folder. It goes when the driver ends, as results may still be read from it."""
    path = f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place)  # what isn't there isn't deleted on exit
    system.deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later uses neither recompute nor depend on live executors."""
    path = f"{scratch(df.sparkSession, 'table')}/rows"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written = path
    return written


def discard(written: DataFrame) -> None:
    """Deletes a table of cut once all that was made of it is written as well: nothing may read it any more."""
    spark = written.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(written._written)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
