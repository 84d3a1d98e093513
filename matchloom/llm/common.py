"""What the corpus operators share: kept tables on the shared folder, and reading a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.session import collected, removed, scratch, shared_folder, ship  # noqa: F401  the operators take them from here

#: The characters that part words: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    ship(spark)
    return shared_folder(spark)


#: Rows of whole texts that go to Python at once, at most.
TEXT_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let the session send TEXT_ROWS rows at once to Python at most, for a plan that runs later: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)


#: Seconds from one collection of the driver's garbage to the next, at least.
COLLECT_S = 4


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, kept in the shared folder: lineage is cut and no later step computes them again.

    What made them is garbage then. Many short jobs fill the driver's heap with it, so it is collected now and then."""
    checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    collected(df.sparkSession, COLLECT_S)
    return kept


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df``, a kept table, with ``name``: 0, 1, ... among the rows of one ``key``, which isn't null.

    Rows are numbered within their partition and start after those of the partitions before, so that no task holds
    all rows of a key."""
    parts = df.withColumn("_in", F.spark_partition_id())
    own = W.partitionBy(key, "_in").orderBy(F.lit(0))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_in").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.groupBy(key, "_in").agg(F.count("*").alias("_n")).select(key, "_in", before.alias("_before")).where(F.col("_before").isNotNull())
    found = parts.withColumn("_own", F.row_number().over(own) - 1).join(starts, [key, "_in"], "left")
    return found.select(*df.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def spread_join(rows: DataFrame, values: DataFrame, key: str, by: str, how: str = "inner", parts: int = 64) -> DataFrame:
    """``rows``, a kept table, joined with ``values``, which has one row a ``key``, so that no task holds all rows of a key.

    Rows are dealt into ``parts`` by ``by`` within their key; each part that there is gets its own row of ``values``.
    A null key has no values."""
    placed = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    there = placed.select(key, "_part").distinct().join(values, key)
    return placed.join(there, [key, "_part"], how).drop("_part")
