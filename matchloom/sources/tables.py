"""Reading and writing the engine's tables: tab-separated sources, result files, Parquet stages, settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom import schemas as S
from matchloom.functions.text import id_list, strip


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A tab-separated file with a header; every cell is text, an empty one is the empty text."""
    read = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').schema(schema)
    return read.csv(path).na.fill("")


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = read_tsv(spark, path, S.RECORD).withColumn("country", strip(F.col("country")))
    return rows.limit(limit) if limit else rows


def read_split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    """The entities and the queries (both noisy sources) of a split."""
    one, two, three = (read_records(spark, f"{folder}/{split}/{split}_source{i}.tsv") for i in (1, 2, 3))
    return one, two.unionByName(three)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, query_id) of a ground truth or result file; blanks and repeats are dropped."""
    rows = read_tsv(spark, path, S.GROUND_TRUTH)
    return rows.select(F.col("source1_entity_id").alias("s1_id"), F.explode(id_list(F.col("matched_entity_ids"))).alias("query_id"))


def write_tsv(lists: DataFrame, path: str) -> None:
    """A result file in one part per partition, in the order of ids, unquoted, with a header."""
    id_, values = lists.columns
    lists.orderBy(id_).select(id_, values).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\0").option("emptyValue", "").csv(path)


def write_stage(df: DataFrame, path: str, by_country: bool = True) -> None:
    """A stage's rows as Parquet. A task's output appears when the job commits, so a broken run leaves nothing behind."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy("country") if by_country else writer).parquet(path)


def stage(spark: SparkSession, path: str, make, again: bool = False) -> DataFrame:
    """The rows kept at ``path``, made first if they aren't there. New rows are written beside old ones and take their place."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if again or not files.exists(folder(f"{path}/_SUCCESS")):
        made = make()
        write_stage(made, f"{path}.new", "country" in made.columns)
        files.delete(folder(path), True)
        if not files.rename(folder(f"{path}.new"), folder(path)):
            raise OSError(f"{path}.new could not be moved to {path}")
    return spark.read.parquet(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    """Settings kept as one JSON text, on any file system that Spark reads; none if there are no such."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return {}
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def merge_settings(spark: SparkSession, path: str, drop: tuple[str, ...] = (), **values) -> dict:
    """The settings at ``path`` with ``values`` over them, after ``drop`` has gone."""
    merged = {k: v for k, v in read_settings(spark, path).items() if k not in drop} | values
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = folder.getFileSystem(spark._jsc.hadoopConfiguration()).create(folder, True)
    out.write(bytearray(json.dumps(merged, ensure_ascii=False, indent=1), "utf-8"))
    out.close()
    return merged
