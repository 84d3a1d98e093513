"""Making a session ready for the library, and scratch tables on its shared folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_matchloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="matchloom-"), "matchloom-package.zip")
    with zipfile.ZipFile(to, "w") as package:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    package.write(path, os.path.join("matchloom", os.path.relpath(path, here)))
    sc.addPyFile(to)
    sc._matchloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, one of our own in local mode; on a cluster that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="matchloom-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def collected(spark: SparkSession, every: float = 0) -> None:
    """Let the driver drop what nothing refers to any more: Spark deletes the shuffles behind it, and its heap shrinks.

    Nothing happens where the last time is less than ``every`` seconds ago."""
    sc, now = spark.sparkContext, time.monotonic()
    if now - getattr(sc, "_matchloom_collected", -every) >= every:
        gc.collect()
        spark._jvm.System.gc()
        sc._matchloom_collected = now


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, kept as a table in the shared folder until the session ends.

    Lineage is cut, so the shuffles that made it are deleted, and no later step computes it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    collected(spark)
    return spark.read.schema(df.schema).parquet(path)
