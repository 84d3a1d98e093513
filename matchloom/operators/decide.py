"""From scored pairs to matches: one owner per record, thresholds, and rules on whole entities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def best_owner(scored: DataFrame) -> DataFrame:
    """The likeliest entity of each record (query_id, s1_id, country, prob); ties go to the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.col("prob").desc(), "s1_id")
    return scored.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("query_id", "s1_id", "country", "prob")


def accepted(best: DataFrame, threshold: float, by_country: Mapping[str, float] | None = None, support: float | None = None, lone: float | None = None) -> DataFrame:
    """The rows of ``best`` that count as matches.

    A row needs its country's threshold, or the general one. ``support``: a lower one, for entities that have a
    match already. ``lone``: a higher one, for the only match of an entity."""
    limit = F.lit(threshold)
    if by_country:
        limit = F.coalesce(F.try_element_at(literal_map_of(by_country), F.col("country")), limit)
    of_entity = W.partitionBy("s1_id")
    rows = best.withColumn("_keep", F.col("prob") >= limit)
    if support is not None:
        rows = rows.withColumn("_keep", F.col("_keep") | ((F.col("prob") >= support) & F.max("_keep").over(of_entity)))
    rows = rows.where("_keep").drop("_keep")
    if lone is not None:
        rows = rows.withColumn("_n", F.count("*").over(of_entity)).where(~((F.col("_n") == 1) & (F.col("prob") < lone))).drop("_n")
    return rows


def literal_map_of(values: Mapping[str, float]):
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])


def lists(pairs: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """One row per entity: source1_entity_id and the sorted ids of its records in ``pairs``, comma-joined."""
    joined = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("query_id")), ",").alias(name))
    ids = entities.select(F.col("entity_id").alias("source1_entity_id"))
    return ids.join(joined, ids["source1_entity_id"] == joined["s1_id"], "left").select("source1_entity_id", F.coalesce(name, F.lit("")).alias(name))


def match_lists(matches: DataFrame, entities: DataFrame) -> DataFrame:
    return lists(matches, entities, "matched_entity_ids")


def candidate_lists(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    return lists(candidates, entities, "candidate_entity_ids")


