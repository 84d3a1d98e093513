"""Sharding along a Hilbert curve, in DataFrame operations only.

Metadata dimensions are quantised to a few bits each by equal depth, the cell of a row gives its index on a
Hilbert curve through all cells, and runs of the rows in curve order become shards. Rows near in all dimensions
are near on the curve, so the files of a shard hold narrow ranges of every dimension and readers skip the rest.

Equal texts are a group: they take the cell of the first of them on the curve and follow each other there, so a
group is cut only where a shard ends. A row's rank in the whole order comes from counts at four nested levels (curve
cell, a slice of the text's checksum, the checksum, a slice of the id's), so no sort, window or task ever holds a hot
cell or a hot group of copies; rows travel without their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled, table

#: Slices of a curve cell by checksum, and of a group of equal texts by id: bounds on what one window holds.
CRC_SLICES, ID_SLICES = 256, 64
#: Rows of one group that meet in a task, at most, and distinct values of a dimension that do, on average.
PART, VALUES = 1_000_000, 1_000_000


def hilbert_index(point: list[int], bits: int) -> int:
    """The place on the Hilbert curve of a cell, by transposing its axes (Gray code, then undoing rotations)."""
    x, n = list(point), len(point)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            if x[i] & bit:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, bit = 0, 1 << (bits - 1)
    while bit > 1:
        if x[n - 1] & bit:
            flip ^= bit - 1
        bit >>= 1
    x = [v ^ flip for v in x]
    index = 0
    for b in reversed(range(bits)):
        for v in x:
            index = index << 1 | v >> b & 1
    return index


def curve_column(codes: list[Column], bits: int) -> Column:
    """The curve index of quantised dimensions: a look-up in the table of all cells, which the rule above fills."""
    n = len(codes)
    if n * bits > 14:
        raise ValueError("dimensions times bits must be 14 at most")
    side = 1 << bits
    cells = [hilbert_index([c // side ** (n - 1 - i) % side for i in range(n)], bits) for c in range(side**n)]
    cell = reduce(lambda a, b: a * side + b, codes)
    return F.element_at(F.lit(cells), (cell + 1).cast("int"))


def coarse_size(size: Column) -> Column:
    """A size as its power of two and the next three bits: at most about 1,000 values, in the order of sizes."""
    power = F.length(F.bin(size))
    return power * 16 + F.floor(size / F.pow(F.lit(2.0), F.greatest(power - 4, F.lit(0)))).cast("int")


def equal_depth(df: DataFrame, dim: str, bits: int) -> Column:
    """Code 0 to 2^bits - 1 of a dimension, each over about as many rows; nulls are last. Equal values share a code.

    Only the first value of each code comes to the driver: 2^bits at most. Many values are summed in ranges first."""
    side = 1 << bits
    counts = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(F.count("*").alias("n"))
    total, values = df.count(), df.agg(F.approx_count_distinct(dim)).first()[0]
    ranges = max(1, -(-values // VALUES))
    counts = counts.repartitionByRange(ranges, "value") if ranges > 1 else counts
    counts = counts.withColumn("_range", F.spark_partition_id() if ranges > 1 else F.lit(0))
    counts = settled(counts) if ranges > 1 else counts
    own = F.coalesce(F.sum("n").over(W.partitionBy("_range").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.sum("m").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.groupBy("_range").agg(F.sum("n").alias("m")).select("_range", earlier.alias("earlier"))  # a row per range
    code = F.floor((own + F.col("earlier")) * side / F.lit(max(total, 1))).cast("int")
    coded = counts.join(starts, "_range").select("value", code.alias("code"))
    found = sorted((r["code"], r["value"]) for r in coded.groupBy("code").agg(F.min("value").alias("value")).collect())
    out = F.lit(side - 1)
    if found:
        out = F.lit(found[0][0])
        for c, value in found[1:]:
            out = F.when(F.col(dim) >= F.lit(value), F.lit(c)).otherwise(out)
    return F.when(F.col(dim).isNull(), F.lit(side - 1)).otherwise(out).cast("int")


def grouped(rows: DataFrame, group: list[str], total: int) -> DataFrame:
    """``rows`` with the least ``curve`` of their ``group``. A group is dealt into parts, which hold its least each."""
    parts = max(16, -(-total // PART))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    each = settled(rows.groupBy(*group, "_part").agg(F.min("curve").alias("_least"), F.count("*").alias("_n")))
    least = each.groupBy(*group).agg(F.min("_least").alias("_least"), F.sum("_n").alias("_n")).where("_n > 1").drop("_n")
    least = each.select(*group, "_part").join(least, group)
    return rows.join(least, [*group, "_part"], "left").withColumn("curve", F.coalesce("_least", "curve")).drop("_least", "_part")


def ranked(df: DataFrame, levels: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rank``, the 0-based place of each row in the order of ``levels`` and then ``order``.

    Counts of each level are summed over the level above, so a window holds the children of one parent only."""
    counts = df.groupBy(*levels).agg(F.count("*").alias("_n"))
    offsets = counts
    for depth in range(len(levels), 0, -1):
        own, above = levels[:depth], levels[: depth - 1]
        at = counts.groupBy(*own).agg(F.sum("_n").alias("_n"))
        window = (W.partitionBy(*above) if above else W.partitionBy()).orderBy(own[-1]).rowsBetween(W.unboundedPreceding, -1)
        at = at.select(*own, F.coalesce(F.sum("_n").over(window), F.lit(0)).alias(f"_before{depth}"))
        offsets = offsets.join(at, own)
    offsets = offsets.select(*levels, sum(F.col(f"_before{d + 1}") for d in range(len(levels))).alias("_before"))
    placed = df.withColumn("_row", F.row_number().over(W.partitionBy(*levels).orderBy(*order)) - 1)
    return placed.join(offsets, levels).withColumn("rank", F.col("_before") + F.col("_row")).drop("_before", "_row")


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = 4, dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and the ``dims``) dealt to shards along the curve; counts are at most one apart.

    The size of the text is a dimension besides ``dims``. Equal texts, whatever their ids and dimensions, take the
    cell of the first of them on the curve and follow each other, so a group of them that is smaller than a shard lies
    in two shards at most, and a larger one fills all shards but its first and last. A null text has no bytes and
    checksum 0; nulls of a dimension come last in it; null and repeated ids are rows as others. Other columns are
    ignored; an empty table gives no rows. The law is ``rows``."""
    text = F.col("text").cast("binary")
    keys = docs.select(
        "doc_id", *[F.col(d).alias(f"_d{i}") for i, d in enumerate(dims)],
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("_hash"),
    )
    keys = settled(keys.withColumn("_size", coarse_size(F.col("size"))))
    names = [f"_d{i}" for i in range(len(dims))] + ["_size"]
    curve = curve_column([equal_depth(keys, d, bits) for d in names], bits)
    total = keys.count()
    placed = grouped(keys.select("doc_id", "size", "text_crc32", "_hash", curve.alias("curve")), ["text_crc32", "size", "_hash"], total)
    placed = placed.select(
        "doc_id", "size", "text_crc32", "curve",
        F.floor(F.col("text_crc32") * CRC_SLICES / F.lit(2**32)).cast("int").alias("_crc"),
        (F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % ID_SLICES).cast("int").alias("_id"),
    )
    least, more = total // shards, total % shards
    rank, edge = F.col("rank"), more * (least + 1)
    shard = F.when(rank < edge, F.floor(rank / F.lit(least + 1)))
    shard = shard.otherwise(more + F.floor((rank - edge) / F.lit(max(least, 1)))).cast("int")
    start = F.when(shard < more, shard * (least + 1)).otherwise(edge + (shard - more) * least)
    return ranked(settled(placed), ["curve", "_crc", "text_crc32", "_id"], ["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"),
        (rank - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("curve").cast("int").alias("curve"),
    )


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))


def _crc_sql(data: str) -> str:
    """The checksum of a list of bytes; ``t.crc`` has that of each single byte."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {data}), lambda a, b: xor(a >> 8, t.crc[(xor(a, b) & 255) + 1])), 4294967295)"


def _depth_sql(dim: str) -> str:
    return f"c_{dim} as (select {dim}, floor(coalesce(sum(count(*)) over (order by {dim} rows between unbounded preceding and 1 preceding), 0) * 16 / (select count(*) from k))::int q_{dim} from k where {dim} is not null group by {dim})"


_DIGIT = "strpos('0123456789ABCDEF', {}) - 1"
_BYTES = f"list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ((({_DIGIT.format('p[1]')}) * 16 + {_DIGIT.format('p[2]')}))::bigint)"
_ID_BYTES = "list_transform(string_split(doc_id::varchar, ''), lambda x: unicode(x)::bigint)"


def _curve_sql() -> str:
    """The curve index of all cells x, y, z of four bits a side, one step of the transposition a common table."""
    axes, steps = ("x", "y", "z"), ["c0 as (select a.i x, b.i y, c.i z, a.i * 256 + b.i * 16 + c.i cell from range(16) a(i), range(16) b(i), range(16) c(i))"]

    def step(**new: str) -> None:
        values = ", ".join(f"{new.get(v, v)} {v}" for v in (*axes, "cell"))
        steps.append(f"c{len(steps)} as (select {values} from c{len(steps) - 1})")

    for bit in (8, 4, 2):
        step(x=f"case when x & {bit} > 0 then xor(x, {bit - 1}) else x end")
        for v in axes[1:]:
            step(x=f"case when {v} & {bit} > 0 then xor(x, {bit - 1}) else xor(x, xor(x, {v}) & {bit - 1}) end", **{v: f"case when {v} & {bit} > 0 then {v} else xor({v}, xor(x, {v}) & {bit - 1}) end"})
    step(y="xor(x, y)", z="xor(xor(x, y), z)")
    flip = "xor(xor(case when z & 8 > 0 then 7 else 0 end, case when z & 4 > 0 then 3 else 0 end), case when z & 2 > 0 then 1 else 0 end)"
    step(**{v: f"xor({v}, {flip})" for v in axes})
    bits = " + ".join(f"(({v} >> {b}) & 1) * {1 << (3 * b + 2 - n)}" for b in range(4) for n, v in enumerate(axes))
    return ", ".join(steps) + f", cu as (select cell, {bits} curve from c{len(steps) - 1})"


OP10_SQL = f"""
with t as (select list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda r, n: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)) crc),
b as (select doc_id, source, lang, text, octet_length(encode(coalesce(text, '')))::bigint + 8 size, {_crc_sql(_BYTES)} text_crc32, {_crc_sql(_ID_BYTES)} % {ID_SLICES} id_slice from documents, t),
k as (select *, length(bin(size)) * 16 + floor(size / pow(2, greatest(length(bin(size)) - 4, 0)))::int coarse from b),
{_depth_sql('source')}, {_depth_sql('lang')}, {_depth_sql('coarse')},
{_curve_sql()},
h as (select k.*, min(curve) over (partition by text) curve from k left join c_source using (source) left join c_lang using (lang) left join c_coarse using (coarse)
  join cu on cell = (coalesce(q_source, 15) * 16 + coalesce(q_lang, 15)) * 16 + coalesce(q_coarse, 15)),
r as (select *, row_number() over (order by curve, floor(text_crc32 * {CRC_SLICES} / 4294967296), text_crc32, id_slice, doc_id) - 1 rk, (select count(*) from documents) // 24 least, (select count(*) from documents) % 24 more from h),
s as (select *, (case when rk < more * (least + 1) then rk // (least + 1) else more + (rk - more * (least + 1)) // greatest(least, 1) end)::int shard from r)
select doc_id, size, text_crc32, 'rows' law, shard, (rk - case when shard < more then shard * (least + 1) else more * (least + 1) + (shard - more) * least end)::bigint slot, null::int grown_shard, curve::int curve from s
"""
