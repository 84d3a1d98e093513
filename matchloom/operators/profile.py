"""What the sources and the truth look like before anything is matched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def emptiness(records: DataFrame) -> DataFrame:
    """Per source (the id's prefix): rows and blank cells of each column, in one pass."""
    blank = [F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) == "").alias(f"blank_{c}") for c in ("entity_id", "business_name", "business_address", "country")]
    return records.groupBy(F.split_part("entity_id", F.lit("-"), F.lit(1)).alias("source")).agg(F.count("*").alias("rows"), *blank)


def country_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(F.split_part("entity_id", F.lit("-"), F.lit(1)).alias("source"), "country").agg(F.count("*").alias("rows"))


def match_histogram(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """How many entities have so many matches, those without among them."""
    n = truth.groupBy(F.col("s1_id").alias("entity_id")).agg(F.count("*").alias("n"))
    return entities.select("entity_id").join(n, "entity_id", "left").groupBy(F.coalesce("n", F.lit(0)).alias("matches")).agg(F.count("*").alias("entities"))


def several_owners(truth: DataFrame) -> DataFrame:
    """Records that more than one entity claims; none, if one owner is the rule."""
    return truth.groupBy("query_id").agg(F.count_distinct("s1_id").alias("owners")).where("owners > 1")


def across_countries(records: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: pairs of two countries, pairs, and pairs with an unknown record."""
    of = records.select("entity_id", "country")
    a, b = of.withColumnsRenamed({"entity_id": "s1_id", "country": "ca"}), of.withColumnsRenamed({"entity_id": "query_id", "country": "cb"})
    d = truth.join(a, "s1_id", "left").join(b, "query_id", "left")
    return d.agg(F.count_if(F.col("ca") != F.col("cb")).alias("across"), F.count("*").alias("pairs"), F.count_if(F.col("ca").isNull() | F.col("cb").isNull()).alias("unknown"))
