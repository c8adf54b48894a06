"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder of its
    own; a cluster must name one, because a machine's own disk is lost with it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[[^\]]*\])?\Z", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="velumra-")
        context.setCheckpointDir(named)
        named = context.getCheckpointDir()
    return named


def table(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: the plan
    that follows starts from files that outlive any executor."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._velumra_path = path
    return again


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in the application's part of the shared
    folder, which is deleted when the driver ends."""
    own = f"{shared_folder(spark)}/velumra/{spark.sparkContext.applicationId}"
    there = spark._jvm.org.apache.hadoop.fs.Path(own)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``table`` that nothing reads any more."""
    path = getattr(df, "_velumra_path", None)
    if path:
        discard(df.sparkSession, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path made by ``fresh``."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def located(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, for readers outside Spark."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any
    more; it does so when the driver collects garbage, which may be late, and
    in the background, so this waits a moment."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.7)
