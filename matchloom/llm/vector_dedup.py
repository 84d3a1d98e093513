"""Near-duplicate vectors by a PCA-ordered tiled comparison.

Vectors are rotated into the principal axes of all vectors, which keeps their products, and put into tiles of
neighbours along these axes. Two tiles are compared only if the boxes around them are near enough for any pair
to reach the threshold. In a comparison the leading axes are summed first: what the others can add is at most the
product of the two suffix norms, so pairs are given up, and whole blocks stopped, once they can't reach it.
A comparison returns counts and a spanning forest of its links, so a group of copies never turns into pairs.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table
from .components import components

TILE = 1024
BLOCK = 256
#: Leading axes in the boxes of tiles, and after how many axes sums are held against their bounds.
BOX_AXES, STEPS = 8, (8, 16, 32)
#: Tiles whose boxes are looked at as one first, and parts of a label in that look.
BOXES, SALTS = 64, 16
#: Rows of a block of the matrix of products, and partial sums of it that meet in the second step.
AXIS_ROWS, FAN_IN = 64, 32
#: What rounding may move a cosine by; pairs so near the threshold are summed again from the vectors as given.
SLACK = 1e-9


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Batches to Python of so many rows at most, where each row is large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """The axes of all vectors, the strongest first.

    Partitions send sums of products in blocks of rows, which are added up in two steps; ``dims`` squared numbers
    come to the driver, as bytes."""

    def products(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch["embedding"], dims))
                total += x.T @ x
        cuts = range(0, dims, AXIS_ROWS)
        part = [TaskContext.get().partitionId() % FAN_IN] * len(cuts)
        yield pa.RecordBatch.from_arrays([pa.array(list(cuts), pa.int32()), pa.array(part, pa.int32()), pa.array([total[c : c + AXIS_ROWS].tobytes() for c in cuts])], ["first", "part", "sums"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in group["sums"])
        return pa.table({"first": group["first"][:1].cast(pa.int32()), "part": group["part"][:1].cast(pa.int32()), "sums": pa.array([total.tobytes()])})

    kind = "first int, part int, sums binary"
    sums = vectors.select("embedding").mapInArrow(products, kind).groupBy("first", "part").applyInArrow(added, kind)
    blocks = {r["first"]: r["sums"] for r in sums.groupBy("first").applyInArrow(added, kind).collect()}
    total = np.concatenate([np.frombuffer(blocks[c]) for c in sorted(blocks)]) if blocks else np.zeros(dims * dims)
    return np.ascontiguousarray(np.linalg.eigh(total.reshape(dims, dims))[1][:, ::-1])


def split_tiles(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in groups of ``most`` at most, halved along the axis that they spread over most."""
    todo, tiles = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            tiles.append(rows)
            continue
        axis = np.ptp(x[rows], axis=0).argmax()
        rows = rows[np.argsort(x[rows, axis], kind="stable")]
        todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    return tiles


def tiles_of(vectors: DataFrame, axes: np.ndarray, most: int = TILE) -> DataFrame:
    """Tiles of ``vectors`` (label, id, copies, embedding): label, tile, low and high of its box, and its rows as bytes."""
    spark, dims = vectors.sparkSession, len(axes)
    shared = spark.sparkContext.broadcast(axes)
    boxes = min(BOX_AXES, dims)

    def lead(batches):
        for batch in batches:
            x = unit(matrix(batch["embedding"], dims)) @ shared.value[:, :1] if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x[:, 0])], [*batch.schema.names, "lead"])

    def build(batches):
        rows = pa.Table.from_batches(batches)
        labels = rows["label"].to_numpy()
        out = []
        for label in np.unique(labels):
            own = rows.take(pa.array(np.flatnonzero(labels == label)))
            x = matrix(own["embedding"], dims)
            axial = (unit(x) @ shared.value)[:, :boxes]
            ids, copies = own["id"].to_numpy(), own["copies"].to_numpy()
            for t in split_tiles(axial, most):
                out.append((label, (TaskContext.get().partitionId() << 32) + len(out), axial[t].min(0), axial[t].max(0), ids[t].astype("<i8").tobytes(), copies[t].astype("<i8").tobytes(), x[t].astype("<f8").tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["label", "tile", "low", "high", "ids", "copies", "x"])

    kind = ", ".join(f"{n} {t}" for n, t in vectors.dtypes)
    led = settled(vectors.mapInArrow(lead, f"{kind}, lead double"))
    parts = max(1, -(-led.count() // (4 * most)))
    ranges = led.repartitionByRange(parts, "label", "lead", "id")
    return settled(ranges.mapInArrow(build, "label int, tile long, low array<double>, high array<double>, ids binary, copies binary, x binary"))


def links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float):
    """For blocks of rows of ``a``: first row, and which of its pairs with ``b`` have a cosine of ``threshold`` or more."""
    ua, ub = unit(a), unit(b)
    pa_, pb = ua @ axes, ub @ axes
    dims = len(axes)
    steps = [s for s in STEPS if s < dims] + [dims]
    left_a, left_b = (np.sqrt(np.maximum(np.cumsum((p * p)[:, ::-1], axis=1)[:, ::-1], 0)) for p in (pa_, pb))
    for first in range(0, len(a), BLOCK):
        block = slice(first, first + BLOCK)
        found = np.zeros((len(pa_[block]), len(b)), bool)
        sums = pa_[block, : steps[0]] @ pb[:, : steps[0]].T
        reach = sums + np.outer(left_a[block, steps[0]], left_b[:, steps[0]]) if steps[0] < dims else sums
        i, j = np.nonzero(reach >= threshold - SLACK)
        total = sums[i, j]
        for s, e in zip(steps, steps[1:]):
            if not len(i):
                break
            total = total + np.einsum("ij,ij->i", pa_[first + i, s:e], pb[j, s:e])
            rest = left_a[first + i, e] * left_b[j, e] if e < dims else 0.0
            keep = total + rest >= threshold - SLACK
            i, j, total = i[keep], j[keep], total[keep]
        near = np.abs(total - threshold) <= SLACK
        if near.any():
            x, y = a[first + i[near]], b[j[near]]
            total[near] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x)) / np.sqrt(np.einsum("ij,ij->i", y, y))
        keep = total >= threshold
        found[i[keep], j[keep]] = True
        yield first, found


def compare(a, b, same: bool, axes: np.ndarray, threshold: float):
    """Links between two tiles (ids, copies, vectors): ids with a link, how many vectors each links to, and the root of its tree."""
    (ids_a, copies_a, x_a), (ids_b, copies_b, x_b) = a, b
    n_a, n_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    root_a, root_b = np.arange(len(ids_a)), np.arange(len(ids_b)) + (0 if same else len(ids_a))
    blocks = []
    for first, found in links(x_a, x_b, axes, threshold):
        if same:
            found[np.arange(len(found)), first + np.arange(len(found))] = False
        if found.any():
            n_a[first : first + len(found)] += found @ copies_b
            n_b += copies_a[first : first + len(found)] @ found
            rows = np.flatnonzero(found.any(axis=1))
            blocks.append((first + rows, found[rows]))
    moved, none = bool(blocks), len(ids_a) + len(ids_b)
    while moved:
        moved = False
        for rows, found in blocks:
            low = np.minimum(root_a[rows], np.where(found, root_b[None, :], none).min(axis=1))
            back = np.where(found, low[:, None], none).min(axis=0)
            if (low < root_a[rows]).any() or (back < root_b).any():
                moved = True
                root_a[rows] = low
                root_b = np.minimum(root_b, back)
                if same:
                    root_a = root_b = np.minimum(root_a, root_b)
    if same:
        keep, ids = n_a > 0, ids_a
        return ids[keep], n_a[keep], ids[root_a[keep]]
    ids, n, root = np.concatenate([ids_a, ids_b]), np.concatenate([n_a, n_b]), np.concatenate([root_a, root_b])
    keep = n > 0
    return ids[keep], n[keep], ids[root[keep]]


def tile_pairs(tiles: DataFrame, boxes: int, reach: float) -> DataFrame:
    """Pairs (tile_a, tile_b) of a label whose boxes are within the square root of ``reach`` of each other.

    Boxes around BOXES neighbouring tiles are held against each other first, in SALTS parts of a label, and only
    what is near enough is taken apart, so no key holds all tiles of a label."""
    gap = "aggregate(zip_with(zip_with({0}.low, {1}.high, (x, y) -> x - y), zip_with({1}.low, {0}.high, (x, y) -> x - y), (x, y) -> pow(greatest(x, y, 0D), 2)), 0D, (s, x) -> s + x)"
    box = tiles.select("label", "tile", "low", "high", F.expr(f"shiftright(tile, 32) * {1 << 24} + (tile & {2**32 - 1}) div {BOXES}").alias("group"))
    around = [F.array(*[f(F.get(c, F.lit(i))) for i in range(boxes)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
    groups = settled(box.groupBy("label", "group").agg(*around, F.collect_list(F.struct("tile", "low", "high")).alias("tiles")))
    one = groups.withColumn("salt", F.pmod(F.xxhash64("group"), F.lit(SALTS)).cast("int")).alias("g")
    other = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("h")
    same = (F.col("g.label") == F.col("h.label")) & (F.col("g.salt") == F.col("h.salt")) & (F.col("g.group") <= F.col("h.group"))
    near = one.join(other, same & (F.expr(gap.format("g", "h")) <= reach))
    pairs = near.select(F.explode("g.tiles").alias("a"), F.col("h.tiles").alias("tiles"), (F.col("g.group") == F.col("h.group")).alias("same"))
    pairs = pairs.select("a", "same", F.explode("tiles").alias("b")).where(~F.col("same") | (F.col("a.tile") <= F.col("b.tile")))
    return pairs.where(F.expr(gap.format("a", "b")) <= reach).select(F.col("a.tile").alias("tile_a"), F.col("b.tile").alias("tile_b"))


def near_vectors(vectors: DataFrame, dims: int, threshold: float) -> DataFrame:
    """Links of ``vectors`` (label, id, copies, embedding of ``dims``): per comparison, id, n_links and the root of its tree."""
    spark = vectors.sparkSession
    axes = principal_axes(vectors, dims)
    shared = spark.sparkContext.broadcast(axes)
    tiles = tiles_of(vectors, axes)
    pairs = settled(tile_pairs(tiles, min(BOX_AXES, dims), 2 - 2 * threshold + SLACK))
    data = lambda s: tiles.select(*[F.col(c).alias(f"{c}_{s}") for c in ("tile", "ids", "copies", "x")])
    joined = pairs.join(data("b"), "tile_b").join(data("a"), "tile_a").select("tile_a", "tile_b", *[f"{c}_{s}" for s in "ab" for c in ("ids", "copies", "x")])

    def run(batches):
        tile = lambda r, s: (np.frombuffer(r[f"ids_{s}"], "<i8"), np.frombuffer(r[f"copies_{s}"], "<i8"), np.frombuffer(r[f"x_{s}"], "<f8").reshape(-1, dims))
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                ids, n, root = compare(tile(r, "a"), tile(r, "b"), r["tile_a"] == r["tile_b"], shared.value, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(root)], ["id", "n_links", "root"])

    with arrow_rows(spark, 8):
        return settled(joined.mapInArrow(run, "id long, n_links long, root long"))


def link_vectors(embeddings: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per row of ``embeddings`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and their cosine is ``threshold`` or more. Vectors that are
    null, empty, zero, or hold nulls or numbers that aren't finite link with nothing, nor do rows without an id,
    whose component is null; vectors of different lengths never link. Equal vectors of a label are compared once.
    Rows that repeat an id with other vectors are one vertex: each has the links of all of them. Other columns are
    ignored."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), "embedding")
    keyed = rows.where(fit).select("vec_id", "label", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"), F.size("embedding").alias("dims"), "embedding")
    classes = settled(keyed.groupBy("label", "dims", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    found = None
    for dims in sorted(r[0] for r in classes.select("dims").distinct().collect()):
        own = near_vectors(classes.where(F.col("dims") == dims).select("label", "id", "copies", "embedding"), dims, threshold)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], "id long, n_links long, root long")
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    classes = classes.select("label", "dims", "h1", "h2", "id", "copies")
    classes = classes.join(counts, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    member = keyed.select("vec_id", "label", "dims", "h1", "h2").join(classes, ["label", "dims", "h1", "h2"])
    member = member.select("vec_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return member.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings
  where embedding is not null and label is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
r as (select vec_id a, vec_id b from embeddings union select r.a, l.b from r join l on l.a = r.b),
c as (select a, min(b) component_id from r group by a),
n as (select a, count(*) n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint n_links, component_id, vec_id = component_id kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
"""
