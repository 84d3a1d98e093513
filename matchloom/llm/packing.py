"""Best-fit-decreasing packing of token sequences, over all documents at once.

Lengths are whole numbers up to the capacity, so the decreasing order of all pieces is known from a histogram of
at most ``capacity`` counts. Best fit walks it with a segment tree over remaining capacities: each look-up finds
the tightest open bins in logarithmic time. Pieces of one length follow each other, and the tightest bin stays
the tightest until it can take no more of them, so a run of equal pieces goes into a run of equal bins in one
step: the result is that of best fit piece by piece, while the plan's size depends on the capacity only.
Pieces then find their place by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled, small_batches, table
from .tokens import encoder

CAPACITY = 2048
#: Pieces of one slice on average, if all had one length: the ranks of a very common length are counted in such parts.
SLICE = 100_000


class CapacityTree:
    """Open bins by what is left in them. A segment tree holds, for each range of capacities, whether any is open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.leaves)
        self.bins: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def mark(self, left: int) -> None:
        i, now = left + self.leaves, bool(self.bins[left])
        while i and self.open[i] != now:
            self.open[i] = now
            i >>= 1
            now = self.open[2 * i] or self.open[2 * i + 1]

    def put(self, left: int, first: int, count: int) -> None:
        """Bins ``first`` to ``first + count - 1`` have ``left`` tokens left."""
        if count and left:
            self.bins[left].append((first, count))
            self.mark(left)

    def take(self, left: int) -> tuple[int, int]:
        run = self.bins[left].popleft()
        self.mark(left)
        return run

    def tightest(self, length: int) -> int | None:
        """The least capacity of ``length`` or more that an open bin has."""
        i = length + self.leaves
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, pieces, first bin, pieces a bin takes, offset): where pieces of a length go."""
    tree, runs, bins = CapacityTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        done, count = 0, histogram[length]
        while done < count:
            left = tree.tightest(length)
            each = (capacity if left is None else left) // length
            need = -(-(count - done) // each)
            if left is None:
                left, first, there = capacity, bins, need
                bins += need
            else:
                first, there = tree.take(left)
            used = min(there, need)
            pieces = min(count - done, used * each)
            runs.append((length, done, pieces, first, each, capacity - left))
            full, rest = divmod(pieces, each)
            tree.put(left - each * length, first, full)
            tree.put(left - rest * length, first + full, int(rest > 0))
            tree.put(left, first + used, there - used)
            done += pieces
    return np.array(runs, np.int64).reshape(-1, 6)


def place(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of pieces by their length and rank among its pieces. ``plan``: sorted by length and rank."""
    lengths, starts = np.unique(plan[:, 0], return_index=True)
    ends = np.append(starts[1:], len(plan))
    bin_, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    order = np.lexsort((rank, length))
    for n, a, b in zip(lengths, starts, ends):
        rows = order[np.searchsorted(length, n, "left", sorter=order) : np.searchsorted(length, n, "right", sorter=order)]
        if len(rows):
            run = plan[a + np.searchsorted(plan[a:b, 1], rank[rows], "right") - 1]
            nth = rank[rows] - run[:, 1]
            bin_[rows] = run[:, 3] + nth // run[:, 4]
            offset[rows] = run[:, 5] + nth % run[:, 4] * n
    return bin_, offset


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: all of ``capacity`` but the first, which may be shorter."""
    first = (len(ids) - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, len(ids), capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", end: int = 0) -> DataFrame:
    """Per piece of each document's ids and its end mark: doc_id, piece, start, length, ids_crc32. A null text is empty."""

    def pieces(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            out, of = [], []
            for row, text in enumerate(batch["text"]):
                ids = np.append(encode.ids(text.as_py() or ""), np.uint32(end)).astype("<u4")
                found = [(n, s, k, zlib.crc32(ids[s : s + k])) for n, (s, k) in enumerate(cut(ids, capacity))]
                out += found
                of += [row] * len(found)
            columns = zip(*out) if out else [[]] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(of, pa.int64())), *arrays], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with ``sequence_id`` and ``offset``.

    The plan that goes to all tasks has a size bound by the capacity alone, whatever the number of pieces."""
    spark = pieces.sparkSession
    pieces = settled(pieces)
    slices = max(256, -(-pieces.count() // SLICE))
    # The partition of the kept table is in the hash, so that rows that repeat an id are spread too.
    keyed = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", F.spark_partition_id()), F.lit(slices)).cast("int"))
    counts = keyed.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = best_fit_plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])
    before = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "_slice", before.alias("_before"))
    own = F.row_number().over(W.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("_own", own).join(offsets, ["length", "_slice"])
    ranked = ranked.select(*pieces.columns, (F.col("_own") + F.col("_before")).cast("long").alias("_rank"))

    def placed(batches):
        for batch in batches:
            bins, offset = place(shared.value, batch["length"].to_numpy(), batch["_rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bins), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    types = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(placed, f"{types}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """All documents (doc_id, text) in as few sequences of at most ``capacity`` tokens as best fit decreasing finds.

    A null or empty text is its end mark alone. Repeated rows and null ids are documents as others; other columns
    are ignored; an empty table gives no rows. Only documents longer than a sequence are cut."""
    return pack(token_pieces(docs, capacity, vocabulary), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
