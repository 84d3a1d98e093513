"""Matching records as they arrive: each micro-batch looks for its owners among the entities, without state.

A record has one owner at most and looks for it by itself, so a batch needs nothing of the batches before it; the
entities' vectors are kept once and every batch looks them up. Batches that are written again replace their files."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchloom.functions.text import normalize
from matchloom.operators import blocking, decide


def match_stream(arriving: DataFrame, entities: DataFrame, path: str, checkpoint: str, threshold: float, k: int = 10) -> StreamingQuery:
    """Start matching the stream ``arriving`` (raw records) with raw ``entities``; matches go to ``path`` by batch.

    The score is the mean similarity of the channels."""
    of = blocking.channels()
    clean = normalize(entities)
    tokens = blocking.weighed(clean, of).persist(StorageLevel.MEMORY_AND_DISK)
    index = blocking.vectors(clean, tokens, of).persist(StorageLevel.MEMORY_AND_DISK)

    def batch(records: DataFrame, number: int) -> None:
        made: list[DataFrame] = []
        found = blocking.neighbours(blocking.vectors(normalize(records), tokens, of), index, k, made)
        pairs = blocking.channel_union(found)
        scored = pairs.withColumn("prob", sum(F.coalesce(f"{c.name}_sim", F.lit(0.0)) for c in of) / len(of))
        decide.accepted(decide.best_owner(scored), threshold).write.mode("overwrite").parquet(f"{path}/batch={number}")
        for kept in made:
            kept.unpersist()

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
