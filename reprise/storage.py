"""Shared scratch space: tables that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one of our own only where that is unset and all runs on one machine (a local master)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="reprise-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; removed when the driver's process ends in an orderly way."""
    path = f"{shared_dir(spark)}/reprise-{label}-{uuid.uuid4().hex}"
    if not _OWN:
        atexit.register(_clean)
    _OWN.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later plans start from files that every executor can read."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the table that materialize() wrote for exactly this DataFrame, once nothing that is still to run reads it. Others are left alone."""
    path = getattr(df, "_scratch", None)
    if path is not None:
        df._scratch = None
        _OWN.remove((df.sparkSession, path))
        delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what has run and can't run again: its cleaner goes by the driver's garbage collection, which may not come for long."""
    gc.collect()
    for wait in (0.3, 0):  # the last run is still held by events that are under way
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _OWN:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before; then the folder's owner cleans up
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
