"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a table that is
written and read again; all but the last return the columns of ``documents``. Rows with nulls in any column, empty
and very long texts, repeated rows and further columns pass through as each stage says; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.common import removed, scratch, table
from matchloom.llm.jaccard_join import near_duplicates_dropped
from matchloom.llm.mixing import mixed_documents
from matchloom.llm.packing import pack_documents
from matchloom.llm.quality import good_documents


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones of ``docs``.

    A null or empty text is judged as one without words, repeated rows are judged alike, and rows without id too."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Rows without id stay; texts without words are no copies of each other; of rows that repeat an id and a text one stays."""
    return near_duplicates_dropped(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weights of the sources take it.

    A text without words weighs nothing and isn't taken; a null source is a source; repeated rows are taken one by one."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2,048 tokens; every row gives a piece at least."""
    return pack_documents(docs)


STAGES = [("quality", keep_good), ("near_copies", drop_near_copies), ("mix", mix), ("pack", pack)]

#: SQL can express neither the classifier's scores nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)  # what it kept is in the next table
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
