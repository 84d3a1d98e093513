"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target of words; a document of it is taken ``target / source words`` times on average, a
whole number of copies plus a fraction. Fractions are rounded in pairs: one side gives words of probability to
the other, in a random direction that keeps both expectations, until one of them is whole. A pair keeps its
expected words exactly, so only the last open document of a source moves its sum. Pairs meet in buckets, from the
longest document down; what stays open in a bucket meets, pair by pair, in a tree of fixed fan-in up to one root.

The last open document can be a long one. What its rounding leaves or takes too many is made up by single copies
of other documents, whose sizes come nearest to what is missing. This is settled on the numbers of documents of
each size, so it takes one small task a source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, numbered, settled, table

#: Documents a bucket holds on average, and open documents that meet in one node of the tree.
BUCKET_ROWS, FAN_IN = 1024, 64
MAX_COPIES = 3
#: So many rows with one id and size go to a bucket, further ones to others.
REPEATS = 64
#: Documents of a source that settle what the last rounding misses, at most.
SETTLE = 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit keys (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pivotal(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions ``part`` so that ``sum(size * part)`` stays; the fractions, and the row still open or -1.

    ``draw``: a uniform number for each row. Rows are met in the order given."""
    part, held = part.copy(), -1
    for j in range(len(part)):
        if not 0 < part[j] < 1:
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min((1 - part[i]) * size[i], part[j] * size[j])  # words that may go from j to i
        down = min(part[i] * size[i], (1 - part[j]) * size[j])
        if draw[j] * (up + down) < down:
            i_full, part_i, part_j = up == (1 - part[i]) * size[i], part[i] + up / size[i], part[j] - up / size[j]
            part[i], part[j] = (1.0, max(part_j, 0.0)) if i_full else (part_i, 0.0)
        else:
            i_empty, part_i, part_j = down == part[i] * size[i], part[i] - down / size[i], part[j] + down / size[j]
            part[i], part[j] = (0.0, min(part_j, 1.0)) if i_empty else (part_i, 1.0)
        held = i if 0 < part[i] < 1 else j if 0 < part[j] < 1 else -1
    return part, held


def settlement(size: np.ndarray, copies: np.ndarray, miss: float, turns: int = SETTLE) -> list[tuple[int, int]]:
    """Rows to change by a copy, (row, 1 or -1), so that ``miss`` words more are taken; each row once at most.

    In each turn the row whose size is nearest to what is missing, if that brings the sum nearer."""
    out, free = [], size > 0
    for _ in range(turns):
        step = 1 if miss > 0 else -1
        fit = np.flatnonzero(free & ((copies < MAX_COPIES) if step > 0 else (copies > 0)))
        if not len(fit):
            break
        best = fit[np.argmin(np.abs(size[fit] - abs(miss)))]
        if abs(miss - step * size[best]) >= abs(miss):
            break
        out.append((int(best), step))
        miss -= step * size[best]
        free[best] = False
    return out


def source_targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size: one row each) with ``target``.

    Weights 1, 2, 3 repeat over sources in code point order, null last, and share all words; a target stops at
    three times its source's words and the excess goes to the others by weight. All sources, a row each, meet in one
    task, which sorts them on disk if they are many. In the order of cap by weight
    the capped sources come first, so running sums give the level of the others."""
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    s = sources.withColumn("_w", (F.row_number().over(order) - 1) % 3 + 1).withColumn("_cap", F.col("source_size") * MAX_COPIES)
    by_cap = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    everything = W.partitionBy()
    s = s.select(
        "*", F.sum("source_size").over(everything).alias("_all"), F.sum("_w").over(everything).alias("_weights"),
        F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_capped"),
        F.coalesce(F.sum("_w").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_passed"),
    )
    level = (F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_passed"))
    s = s.withColumn("_level", F.when(F.col("_cap") >= level * F.col("_w"), level))
    s = s.withColumn("_level", F.first("_level", ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def rounded(rows: pa.Table, seed: int, last: bool) -> pa.Table:
    """One node of the tree: the rows of a bucket; of each source one stays open at most, none if ``last``."""
    key = mix64(rows["_draw"].to_numpy().view(np.uint64) ^ np.uint64(seed))
    draw = (mix64(key) >> np.uint64(11)) * 2.0**-53
    size, part = rows["size"].to_numpy().astype(np.float64), rows["_part"].to_numpy().copy()
    order = np.lexsort((key, -size))
    codes = pd.factorize(rows["source"].to_pandas(), use_na_sentinel=False)[0]
    at = rows.schema.get_field_index("_part")
    order = order[np.argsort(codes[order], kind="stable")]
    for own in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        own = own[(part[own] > 0) & (part[own] < 1)]
        part[own], held = pivotal(size[own], part[own], draw[own])
        if held >= 0 and last:
            part[own[held]] = float((mix64(key[own[held : held + 1]] ^ np.uint64(1)) >> np.uint64(11))[0]) * 2.0**-53 < part[own[held]]
    return rows.set_column(at, "_part", pa.array(part))


def node_of(seed: int, last: bool):
    def node(bucket: pa.Table) -> pa.Table:
        return rounded(bucket, seed, last)

    return node


def settle(rows: pa.Table) -> pa.Table:
    """Of one source: the rows to change and by how many copies. ``rows``: size, copies, how many rows have both, and one of these."""
    order = np.lexsort((rows["copies"].to_numpy(), rows["size"].to_numpy()))
    size, copies, n, one = (rows[c].to_numpy()[order] for c in ("size", "copies", "n", "one"))
    miss = rows["target"][0].as_py() - float((size * copies * n).sum())
    found = settlement(size, copies, miss)
    return pa.table({"_row": pa.array(one[[i for i, _ in found]], pa.int64()), "_change": pa.array([c for _, c in found], pa.int32())})


def mix_sources(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, copies and taken words.

    A null text has size 0 and is taken 0 times; a null source is a source, ordered last; repeated rows and null
    ids are documents as others. Other columns are ignored; an empty table gives no rows. Draws depend on the
    row alone and buckets on the row and the number of rows, so reruns agree on any cluster; rows that are equal
    in id, size and source may change places."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = settled(sized.select("*", F.xxhash64("doc_id", "size", F.lit(seed)).alias("_key"), F.monotonically_increasing_id().alias("_row")))
    totals = settled(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    own, all_sources = numbered(sized, "_key", "_nth").alias("d"), totals.alias("t")
    rows = own.join(all_sources, F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "source_size", "target", share.alias("_share"))
    rows = rows.select(
        "doc_id", "source", "size", "_row", "source_size", "target", "_key",
        F.when(F.col("size") > 0, F.floor("_share")).otherwise(0).cast("int").alias("_whole"),
        F.when(F.col("size") > 0, F.col("_share") - F.floor("_share")).otherwise(0.0).alias("_part"),
        # Rows of one id and size are in one bucket only as many at a time as REPEATS.
        F.pmod(F.xxhash64("_key", F.floor(F.col("_nth") / REPEATS)), F.lit(buckets)).alias("_bucket"),
        F.xxhash64("_key", "_nth").alias("_draw"),
    )
    done, open_rows = None, rows
    while True:
        last = buckets == 1
        level = settled(open_rows.groupBy("_bucket").applyInArrow(node_of(seed, last), rows.schema))
        still = (F.col("_part") > 0) & (F.col("_part") < 1)
        closed = level.where(~still)
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        buckets = -(-buckets // FAN_IN)
        open_rows = level.where(still).withColumn("_bucket", F.floor(F.col("_bucket") / FAN_IN))
    taken = done.withColumn("copies", (F.col("_whole") + F.col("_part")).cast("int"))
    classes = taken.groupBy("source", "size", "copies").agg(F.count("*").alias("n"), F.min("target").alias("target"), F.min_by("_row", F.struct("_key", "_row")).alias("one"))
    changes = settled(classes.groupBy("source").applyInArrow(settle, "_row long, _change int"))
    taken = taken.join(changes, "_row", "left").withColumn("copies", F.col("copies") + F.coalesce("_change", F.lit(0)))
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as the mix takes it, with the columns of ``docs``.

    A null text or one without words is taken 0 times. Rows are found by id, size and source; rows that share all
    three are numbered, and take the numbers of copies in turn, whichever of them."""
    times = [F.count_if(F.col("copies") >= n).alias(f"_mix_{n}") for n in range(1, MAX_COPIES + 1)]
    mixed = mix_sources(docs, seed).groupBy("doc_id", "size", "source").agg(F.count("*").alias("_mix_rows"), *times)
    mixed = settled(mixed.where("_mix_1 > 0").withColumnsRenamed({"doc_id": "_mix_id", "size": "_mix_size", "source": "_mix_source"}))
    own = docs.withColumn("_mix_words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    match = own["doc_id"].eqNullSafe(mixed["_mix_id"]) & (own["_mix_words"] == mixed["_mix_size"]) & own["source"].eqNullSafe(mixed["_mix_source"])
    joined = own.join(mixed, match)
    found = joined.where("_mix_rows = 1").withColumn("_mix_nth", F.lit(0).cast("long"))
    if mixed.where("_mix_rows > 1").limit(1).count():
        several = settled(joined.where("_mix_rows > 1").withColumn("_mix_key", F.xxhash64("_mix_id", "_mix_size", "_mix_source")))
        found = found.unionByName(numbered(several, "_mix_key", "_mix_nth").drop("_mix_key"))
    taken = sum((F.col("_mix_nth") < F.col(f"_mix_{n}")).cast("int") for n in range(1, MAX_COPIES + 1))
    return found.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), taken))).select(*docs.columns)
