"""Connected components of an edge table, by alternating large and small stars, or in one task where it is small."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, spread_join

#: So many edges are united by one task, which takes a few tens of MB; more go through the rounds of stars.
ONE_TASK = 400_000


def united(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """For nodes 0, 1, ..., with edges from ``a`` to ``b``, the least node of the component of each."""
    root = list(range(nodes))
    for x, y in zip(a.tolist(), b.tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    for x in range(len(root)):  # a root is never larger than what points at it
        root[x] = root[root[x]]
    return np.array(root, np.int64)


def _in_one_task(batches):
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    rows = pa.Table.from_batches(rows).combine_chunks()
    both = pa.concat_arrays([rows[c].chunk(0) for c in "uv"])
    fields = both.flatten() if pa.types.is_struct(both.type) else [both]
    values = [f.to_numpy() for f in fields]
    order = np.lexsort(values[::-1])
    new = np.any([v[order][1:] != v[order][:-1] for v in values], axis=0)
    dense = np.empty(len(order), np.int64)
    dense[order] = np.concatenate([[0], np.cumsum(new)])
    first = order[np.concatenate([[0], np.flatnonzero(new) + 1])]
    root = united(dense[: len(rows)], dense[len(rows) :], len(first))
    yield pa.RecordBatch.from_arrays([both.take(pa.array(first)), both.take(pa.array(first[root]))], ["node", "component"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long, or structs of longs without nulls) to (node, component): the smallest node that each node of an edge reaches.

    A large star links each node's larger neighbours to its least neighbour, a small star its smaller ones; when
    nothing changes every node points at the least of its component. Minima are combined before they are shuffled,
    and neighbours of a hot node are dealt into parts. Loops are dropped."""
    kind = edges.schema["a"].dataType
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, before = settled(edges.distinct()), None
    if edges.count() <= ONE_TASK:
        return settled(edges.coalesce(1).mapInArrow(_in_one_task, f"node {kind.simpleString()}, component {kind.simpleString()}"))
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settled(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settled(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
