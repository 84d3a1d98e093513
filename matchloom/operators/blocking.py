"""Candidate generation: TF-IDF nearest neighbours in three channels, by posting lists.

Every noisy record (query) looks for clean entities of its country. A posting is (country, channel, token,
weight); the similarity of a query and an entity is the sum of products over tokens they share. Tokens that too
many entities hold are dropped first: that bounds the length of a posting list. Products of a query are added up
within one task and leave it as its nearest entities, so pairs that merely share a token never reach a disk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import words
from matchloom.session import written

#: Tokens that so few entities hold are never dropped.
DF_FLOOR = 50
#: Different vectors of entities, and vectors of queries, that a task holds at once. Vectors of entities are dealt out once a lane.
SHARD, LANE = 250_000, 200_000
#: Vectors of queries whose nearest ones are put together at once.
TOGETHER = 20_000


@dataclass(frozen=True)
class Channel:
    """A view of a record as tokens. ``most``: the share of a country's entities that may hold a token."""

    name: str
    tokens: Column
    most: float


def trigrams(c: Column) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))
    return F.when(F.length(c) >= 3, grams).otherwise(F.array().cast("array<string>"))


def channels() -> list[Channel]:
    both_names = F.concat_ws(" ", "name_main", "name_alt")
    return [Channel("name", words(both_names), 0.005), Channel("addr", words(F.col("addr_norm")), 0.005), Channel("char", trigrams(F.col("name_nospace")), 0.01)]


def token_rows(records: DataFrame, of: list[Channel], once: bool = False) -> DataFrame:
    """(country, entity_id, channel, token): all channels in one pass; ``once``: without a record's repeats."""
    views = [F.struct(F.lit(c.name).alias("channel"), c.tokens.alias("tokens")) for c in of]
    rows = records.select("country", "entity_id", F.explode(F.array(*views)).alias("v")).select("country", "entity_id", "v.*")
    return rows.select("country", "entity_id", "channel", F.explode(F.array_distinct("tokens") if once else F.col("tokens")).alias("token"))


def weighed(entities: DataFrame, of: list[Channel]) -> DataFrame:
    """(country, channel, token, idf, common) of all tokens that entities hold; ``common``: too many of them do."""
    most = F.coalesce(*[F.when(F.col("channel") == c.name, F.lit(c.most)) for c in of])
    n = entities.groupBy("country").agg(F.count("*").alias("n"))
    df = token_rows(entities, of, once=True).groupBy("country", "channel", "token").agg(F.count("*").alias("df")).join(n, "country")
    common = F.col("df") > F.greatest(F.lit(DF_FLOOR), F.floor(most * F.col("n")))
    return df.select("country", "channel", "token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), common.alias("common"))


def vocabulary(entities: DataFrame, of: list[Channel]) -> DataFrame:
    """(country, channel, token, idf) of tokens that entities hold and that aren't too common among them."""
    return weighed(entities, of).where("not common").drop("common")


def vectors(records: DataFrame, tokens: DataFrame, of: list[Channel]) -> DataFrame:
    """(country, channel, entity_id, v): each record's weights by token, sorted by token, at length 1.

    ``tokens``: as ``weighed`` gives them. Common ones leave before anything is dealt out. There are few of them
    however many the entities: a record's number of tokens over the share that makes one common."""
    common = tokens.where("common").select("country", "channel", "token")
    rows = token_rows(records, of).join(F.broadcast(common), ["country", "channel", "token"], "left_anti")
    rows = rows.join(tokens.where("not common").drop("common"), ["country", "channel", "token"])
    held = rows.groupBy("country", "channel", "entity_id").agg(F.array_sort(F.collect_list(F.struct("token", "idf"))).alias("t"))
    repeats = lambda x: F.size(F.filter("t", lambda y: y["token"] == x["token"]))
    raw = held.withColumn("v", F.transform(F.array_distinct("t"), lambda x: F.struct(x["token"].alias("token"), ((1 + F.log(repeats(x))) * x["idf"]).alias("w"))))
    # sorted, so that equal records have equal weights to the last bit
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    raw = raw.withColumn("norm", norm)
    return raw.select("country", "channel", "entity_id", F.transform("v", lambda x: F.struct(x["token"].alias("token"), (x["w"] / F.col("norm")).alias("w"))).alias("v"))


def postings(of_records: DataFrame) -> DataFrame:
    """``vectors`` as rows: country, channel, token, entity_id, w."""
    return of_records.select("country", "channel", "entity_id", F.explode("v").alias("p")).select("country", "channel", "p.token", "entity_id", "p.w")


def nearest(k: int):
    """Of a share of the queries' vectors and of the entities': the ``k`` nearest entities of each query."""

    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        rows, lists = np.zeros(0, np.int64), pa.array([], BEST)
        if held.num_rows and asked.num_rows:
            rows, lists = _nearest(asked, held, k)
        columns = [pa.array([s.as_py()] * len(rows), pa.string()) for s in key[:2]]
        return pa.Table.from_arrays([*columns, asked["query_id"].take(pa.array(rows)), lists], ["country", "channel", "query_id", "best"])

    return run


BEST = pa.list_(pa.struct([("s1_id", pa.string()), ("sim", pa.float64())]))


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The start of each vector and the end of the last, all tokens, all weights."""
    of = lists.combine_chunks()
    of = of if isinstance(of, pa.Array) else pa.concat_arrays(of.chunks)
    starts, flat = np.r_[0, np.cumsum(pc.list_value_length(of).to_numpy(zero_copy_only=False))], of.flatten()
    return starts, pc.struct_field(flat, "token"), pc.struct_field(flat, "w").to_numpy()


def _nearest(asked: pa.Table, held: pa.Table, k: int) -> tuple[np.ndarray, pa.Array]:
    """The rows of ``asked`` that meet any vector, and the list of each. Equal vectors are looked up once."""
    held = held.take(pc.sort_indices(pc.list_element(held["ids"], 0)))  # so that of equals the first vector has the smallest id
    starts, tokens, weights = _flat(held["v"])
    coded = tokens.dictionary_encode()
    code = coded.indices.to_numpy()
    by_token = np.argsort(code, kind="stable")
    rows, weights = np.repeat(np.arange(held.num_rows), np.diff(starts))[by_token], weights[by_token]
    ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
    begins = np.r_[0, ends[:-1]]
    q_starts, q_tokens, q_weights = _flat(asked["v"])
    q_code = pc.fill_null(pc.index_in(q_tokens, value_set=coded.dictionary), -1).to_numpy()
    total = np.zeros(held.num_rows)
    ids = held["ids"].combine_chunks()
    ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
    n_ids, flat = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64), ids.flatten()
    begin_ids, id_order = np.cumsum(n_ids) - n_ids, np.empty(len(flat), np.int64)
    id_order[pc.sort_indices(flat).to_numpy()] = np.arange(len(flat))

    def listed(whose: list, found: list, sims: list) -> tuple[np.ndarray, pa.Array]:
        """The queries of these nearest vectors, and the nearest entities of each."""
        whose, found, sims = np.concatenate(whose), np.concatenate(found), np.concatenate(sims)
        n = n_ids[found]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin_ids[found], n)
        whose, sims = np.repeat(whose, n), np.repeat(sims, n)
        order = np.lexsort((id_order[at], -np.round(sims, 9), whose))
        at, whose, sims = at[order], whose[order], sims[order]
        first = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])
        nth = np.arange(len(whose)) - np.repeat(first, np.diff(np.r_[first, len(whose)]))
        at, whose, sims = at[nth < k], whose[nth < k], sims[nth < k]
        keys, counts = np.unique(whose, return_counts=True)
        pairs = pa.StructArray.from_arrays([flat.take(pa.array(at)), pa.array(sims)], ["s1_id", "sim"])
        return keys, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pairs)

    whose, found, sims, done = [], [], [], []
    seen, first_equal = {}, np.empty(asked.num_rows, np.int64)
    for q in range(asked.num_rows):
        own = slice(q_starts[q], q_starts[q + 1])
        first_equal[q] = seen.setdefault(q_code[own].tobytes() + q_weights[own].tobytes(), q)
        if first_equal[q] < q:
            continue
        parts = []
        for i in range(own.start, own.stop):
            if (c := q_code[i]) >= 0:
                part = rows[begins[c] : ends[c]]
                total[part] += q_weights[i] * weights[begins[c] : ends[c]]  # a vector has a token once
                parts.append(part)
        if not parts:
            continue
        met = parts[0] if len(parts) == 1 else np.concatenate(parts)
        values, most = total[met], k * len(parts)  # a vector is met once a token at most
        if len(met) > most:
            met_best = met[values >= np.partition(values, len(met) - most)[len(met) - most] - 1e-8]
        else:
            met_best = met
        best = np.unique(met_best) if len(parts) > 1 else met_best
        near = total[best]
        # each vector stands for an entity at least, so the first k in this order hold the first k entities
        order = np.lexsort((best, -np.round(near, 9)))[:k]
        whose.append(np.full(len(order), q))
        found.append(best[order])
        sims.append(near[order])
        total[met] = 0
        if len(whose) == TOGETHER:
            done.append(listed(whose, found, sims))
            whose, found, sims = [], [], []
    if whose:
        done.append(listed(whose, found, sims))
    if not done:
        return np.zeros(0, np.int64), pa.array([], BEST)
    keys, lists = np.concatenate([d[0] for d in done]), pa.concat_arrays([d[1] for d in done])
    place = np.full(asked.num_rows, -1)
    place[keys] = np.arange(len(keys))
    place = place[first_equal]
    answered = np.flatnonzero(place >= 0)
    return answered, lists.take(pa.array(place[answered]))


def persisted(df: DataFrame, name: str) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def neighbours(queries: DataFrame, entities: DataFrame, k: int, made: list[DataFrame] | None = None, keep: Callable[[DataFrame, str], DataFrame] = persisted) -> DataFrame:
    """The ``k`` nearest entities of each query by channel, of ``vectors`` of both: country, channel, query_id, s1_id, sim, rank.

    Ties go to the smaller id, after rounding away what the order of sums may change. Equal vectors of a task are looked
    up once, and one of many entities gives its ``k`` smallest ids. Vectors of entities are parted into shards by
    themselves and those of queries into lanes by id, so that copies are spread; a task has one of each, and only a
    query's own lists leave it. The rows come dealt out by query_id. Vectors are used several times and kept by
    ``keep``; ``made`` gets these tables, for callers that drop them."""
    kind = ["country", "channel"]
    name = [F.xxhash64(F.lit(i), "v").alias(f"h{i}") for i in (1, 2)]
    asked = keep(queries.select(*kind, F.col("entity_id").alias("query_id"), "v"), "asked")
    e = entities.select(*kind, "entity_id", "v", *name).groupBy(*kind, "h1", "h2").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.collect_list("entity_id")), 1, k).alias("ids"))
    e = keep(e.drop("h1", "h2"), "held")
    if made is not None:
        made += [asked, e]
    parts = lambda of, most, n: of.groupBy(*kind).agg(F.ceil(F.count("*") / most).cast("int").alias(n))
    grid = F.broadcast(parts(asked, LANE, "lanes").join(parts(e, SHARD, "shards"), kind))  # a row per country and channel
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = [*kind, "lane", "shard"]
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fresh = [F.col(c).alias(c) for c in kind]  # the two sides come of one table, whose columns would be ambiguous
    left = asked.join(grid, kind).select(*fresh, "query_id", "v", place("query_id", "lanes").alias("lane"), every("shards").alias("shard")).repartition(n, *cell)
    right = e.join(grid, kind).select(*fresh, "v", "ids", place("v", "shards").alias("shard"), every("lanes").alias("lane")).repartition(n, *cell)
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(nearest(k), "country string, channel string, query_id string, best array<struct<s1_id string, sim double>>")
    in_order = F.transform(F.flatten(F.collect_list("best")), lambda x: F.struct((-F.round(x["sim"], 9)).alias("o"), x["s1_id"].alias("s1_id"), x["sim"].alias("sim")))
    lists = found.repartition("query_id").groupBy(*kind, "query_id").agg(F.slice(F.array_sort(in_order), 1, k).alias("best"))
    own = lists.select(*kind, "query_id", F.posexplode("best").alias("pos", "b"))
    return own.select(*kind, "query_id", "b.s1_id", "b.sim", (F.col("pos") + 1).alias("rank"))


def channel_union(found: DataFrame, names: tuple[str, ...] = ("name", "addr", "char")) -> DataFrame:
    """One row per candidate pair, with a similarity and rank per channel, null where it wasn't retrieved: one aggregate, no outer joins."""
    columns = [F.max(F.when(F.col("channel") == c, F.col(x))).alias(f"{c}_{x}") for c in names for x in ("sim", "rank")]
    return found.groupBy("query_id", "s1_id", "country").agg(*columns)


def block(entities: DataFrame, queries: DataFrame, k: int = 10, of: list[Channel] | None = None) -> DataFrame:
    """Candidate pairs of normalized ``queries`` and ``entities``. A country without entities gives none.

    Vectors are made at once and written, so that what dealt out their tokens can leave the disk before they meet."""
    of = of or channels()
    tokens = weighed(entities, of).persist(StorageLevel.MEMORY_AND_DISK)
    found = neighbours(vectors(queries, tokens, of), vectors(entities, tokens, of), k, keep=written)
    return channel_union(found, tuple(c.name for c in of))


def orphans(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries of countries that hold no entity."""
    return queries.join(entities.select("country").distinct(), "country", "left_anti")


def label(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """``candidates`` with is_match, by ``truth`` (s1_id, query_id), of which a record has one row at most."""
    owner = truth.select("query_id", F.col("s1_id").alias("_owner"))
    return candidates.join(owner, "query_id", "left").withColumn("is_match", F.coalesce(F.col("_owner") == F.col("s1_id"), F.lit(False)).cast("int")).drop("_owner")
