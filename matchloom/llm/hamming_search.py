"""Exact nearest binary codes by incremental multi-index hashing.

A code is cut into segments of 16 bits. If all codes within radius r of a query's segments have been seen in the
first j + 1 segments, and within r - 1 in the rest, every code at a distance of m * r + j or less has been: so
radii grow one segment at a time until the k-th verified distance is no more than that. Codes are indexed in
shards of bounded size; equal codes are one entry. Each query meets one shard first, and the k-th distance there
ends its search in the others as soon as they have covered it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled, table

SEGMENT = 16
#: Codes in a shard of the index, and queries that one task looks up in it, on average.
SHARD, QUERIES = 262_144, 65_536
#: Rows of one code are gathered in so many parts first.
SALTS = 64


def masks(radius: int) -> np.ndarray:
    """All segments with ``radius`` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(SEGMENT), radius)], np.int64)


class MultiIndex:
    """An index of distinct codes, given as rows of 64-bit words. ``weights``: rows that each code stands for; ``first``: their smallest id."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, first: np.ndarray):
        self.words, self.weights, self.first = words, weights, first
        self.segments = words.shape[1] * 64 // SEGMENT
        values = words.view("<u2").reshape(len(words), self.segments).astype(np.int64)
        self.order = np.argsort(values, axis=0, kind="stable")
        counts = np.stack([np.bincount(values[:, s], minlength=1 << SEGMENT) for s in range(self.segments)])
        self.starts = np.concatenate([np.zeros((self.segments, 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
        self.held = [np.flatnonzero(c) for c in counts]
        self.masks: dict[int, np.ndarray] = {}

    def probe(self, segment: int, value: int, radius: int) -> np.ndarray:
        """Codes whose segment differs from ``value`` in just ``radius`` bits."""
        held = self.held[segment]
        if radius not in self.masks:
            self.masks[radius] = masks(radius)
        if len(self.masks[radius]) < len(held):
            values = self.masks[radius] ^ value
        else:
            values = held[np.bitwise_count(held ^ value) == radius]
        begin, n = self.starts[segment][values], self.starts[segment][values + 1] - self.starts[segment][values]
        begin, n = begin[n > 0], n[n > 0]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.order[at, segment]

    def nearest(self, query: np.ndarray, k: int, bound: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Codes that hold the ``k`` nearest rows, in the order of distance and smallest id, and their distances.

        Each code stands for a row at least, so the first ``k`` codes in this order hold the first ``k`` rows.
        With ``bound`` only codes at that distance or nearer are looked for."""
        values = query.view("<u2").astype(np.int64)
        seen = np.zeros(len(self.words), bool)
        found, far = [], []
        for radius, segment in itertools.product(range(SEGMENT + 1), range(self.segments)):
            new = self.probe(segment, int(values[segment]), radius)
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                found.append(new)
                far.append(np.bitwise_count(self.words[new] ^ query).sum(axis=1).astype(np.int64))
            covered = self.segments * radius + segment
            if found:
                codes, distance = np.concatenate(found), np.concatenate(far)
                if self.weights[codes[distance <= covered]].sum() >= k:
                    break
                found, far = [codes], [distance]
            if bound is not None and covered >= bound:
                break
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, distance = np.concatenate(found), np.concatenate(far)
        if bound is not None:
            codes, distance = codes[distance <= bound], distance[distance <= bound]
        order = np.lexsort((self.first[codes], distance))[:k]
        return codes[order], distance[order]


def sign_codes(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, embedding) with ``code``: a bit for each component, set if it is positive, in 64-bit words.

    Vectors that are null or empty or hold nulls or numbers that aren't finite have no code and are left out."""
    e = F.col("embedding")
    fit = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & (F.size(e) > 0)

    def pack(batches):
        for batch in batches:
            lists, codes = batch["embedding"], np.empty(batch.num_rows, object)
            length = pc.list_value_length(lists).to_numpy()
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                bits = lists.take(pa.array(own)).flatten().to_numpy().reshape(-1, n) > 0
                packed = np.packbits(np.pad(bits, ((0, 0), (0, -n % 64))), axis=1, bitorder="little")
                codes[own] = [x.tobytes() for x in packed]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(codes, pa.binary())], ["vec_id", "code"])

    return vectors.where(fit & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "embedding").mapInArrow(pack, "vec_id long, code binary")


FOUND = "asked binary, code binary, distance int, reach int"


def look_up(keep: int):
    """Of one shard and a share of the queries: the nearest codes of each, and the distance that ``keep`` rows lie within."""

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        words = lambda codes: np.frombuffer(b"".join(codes), "<u8").reshape(len(codes), -1)
        out = []
        if held.num_rows and asked.num_rows:
            texts, weights = held["code"].to_pylist(), held["weight"].to_numpy()
            index = MultiIndex(words(texts), weights, held["first"].to_numpy())
            queries = asked["code"].to_pylist()
            for text, query, bound in zip(queries, words(queries), asked["bound"].to_pylist()):
                codes, distance = index.nearest(query, keep, bound)
                rows = np.cumsum(weights[codes])
                reach = int(distance[np.searchsorted(rows, keep)]) if len(rows) and rows[-1] >= keep else None
                out += [(text, texts[c], int(d), reach) for c, d in zip(codes, distance)]
        columns = zip(*out) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32(), pa.int32()))], ["asked", "code", "distance", "reach"])

    return run


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` other rows of ``codes`` (vec_id, code) nearest to each row of ``queries`` by Hamming distance.

    Returns query_id, rank from 1, vec_id, distance; ties go to the smaller id. With fewer other rows than ``k``
    there are fewer ranks. Codes of another length than the query's are no neighbours. Of rows that repeat an id
    the one with the least code stands, as row and as query; rows without id or code are left out. Other columns
    are ignored. Both tables may be empty."""
    spark = codes.sparkSession
    once = lambda df: settled(df.where("vec_id is not null and code is not null").groupBy("vec_id").agg(F.min("code").alias("code")))
    rows, asked = once(codes), once(queries)
    keep = k + 1  # one may be the query itself
    # Of a code that many rows share, salted parts give their smallest ids first.
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    some = salted.withColumn("_nth", F.row_number().over(W.partitionBy("code", "_salt").orderBy("vec_id"))).where(F.col("_nth") <= keep)
    some = some.withColumn("_nth", F.row_number().over(W.partitionBy("code").orderBy("vec_id"))).where(F.col("_nth") <= keep)
    entries = settled(some.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked_codes = asked.select("code").distinct()
    n_codes, n_asked = entries.count(), asked_codes.count()
    shards = max(1, -(-n_codes // SHARD))
    # A shard is looked up by several tasks where there are few shards, or more queries than a task should hold.
    lanes = max(1, -(-n_asked // QUERIES), min(-(-n_asked // 32), -(-3 * spark.sparkContext.defaultParallelism // shards)))
    place = lambda n, seed: F.pmod(F.xxhash64("code", F.lit(seed)), F.lit(n)).cast("int")
    all_lanes = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    keys = ["width", "shard", "lane"]
    index = entries.select(F.length("code").alias("width"), place(shards, 1).alias("shard"), "code", F.size("ids").alias("weight"), F.get("ids", F.lit(0)).alias("first"))
    index = index.select("*", all_lanes).repartition(shards * lanes, *keys)
    own = asked_codes.select(F.length("code").alias("width"), "code", place(lanes, 2).alias("lane"), place(shards, 3).alias("home"))

    def search(part: DataFrame) -> DataFrame:
        dealt = part.select(*keys, "code", "bound").repartition(shards * lanes, *keys)
        return settled(index.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(look_up(keep), FOUND))

    found = search(own.select("*", F.col("home").alias("shard"), F.lit(None).cast("int").alias("bound")))
    if shards > 1:
        bounds = found.groupBy(F.col("asked").alias("code")).agg(F.max("reach").alias("bound"))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))).alias("shard")
        found = found.unionByName(search(own.join(bounds, "code", "left").select("*", others)))
    # Of each query code, rows come from its nearest codes in the order of distance; a code gives its smallest ids.
    near = found.join(entries, "code").select("asked", "distance", F.explode("ids").alias("vec_id"))
    by_code = W.partitionBy("asked").orderBy("distance", "vec_id")
    near = near.withColumn("_nth", F.row_number().over(by_code)).where(F.col("_nth") <= keep)
    lists = near.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("_nth", "vec_id", "distance"))).alias("_near"))
    own = asked.withColumnRenamed("vec_id", "query_id").join(lists.withColumnRenamed("asked", "code"), "code")
    own = own.select("query_id", F.posexplode(F.slice(F.filter("_near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)))
    return own.select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", "col.distance")


def op7_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"))
    return top_k(codes, codes.where("vec_id % 20 = 0"))


OP7_SQL = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: (x > 0)::int) c from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select q.vec_id query_id, v.vec_id, list_sum(list_transform(list_zip(q.c, v.c), lambda z: abs(z[1] - z[2])))::int distance
  from v q join v on q.vec_id % 20 = 0 and v.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by distance, vec_id)::int as rank, vec_id, distance from p)
select * from r where rank <= 10
"""
