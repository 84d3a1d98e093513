"""WARC archives: writing pages, reading them back, and one globally ordered index of all captures.

Records are written by Spark's text writer with the blank line that ends a WARC record as its line separator, so
archives are plain files on any file system that Spark writes to, and a lost task is simply written again. Each
archive is parsed by one task, which sorts its captures by URL key and time: a run, kept as a table. The runs are
merged as external sorting does it: the key space is cut into ranges of a bounded number of captures, and in each
range the pieces of the k runs meet in a loser tree that always yields the least key, with one comparison a level.
Captures leave the merge in global order, numbered within the history of their URL key; what a range must know of
the ones before it is a number for its first key.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, scratch, settled, table

END = "\r\n\r\n"
#: Payloads of fewer bytes are never written as revisits.
REVISIT_FROM = 100
#: The time of captures that have none: this second of the epoch plus their id, within this many seconds.
FIRST_SECOND, SECONDS = 1_600_000_000, 1_000_000_000
#: The last second that a date of four digits in the year can say.
LAST_SECOND = 253_402_300_799
#: Records of an archive, and captures of a range of the merge on average: what a task holds at once.
ARCHIVE, RANGE = 10_000, 100_000


def url_key(url: Column) -> Column:
    """A URL in the order of indexes: host labels from the top level down, then path and query; no scheme, port, ``www`` or fragment."""
    plain = F.lower(F.coalesce(url, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(plain, r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(plain, r"^([^/?]*)", 1), r"^(?:[^@]*@)?(?:www\d*\.)?|:\d*$", "")
    rest = F.regexp_extract(plain, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def deduplicated(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, payload: binary and more) with payload_digest, record_type and refers_to.

    Of equal payloads of REVISIT_FROM bytes or more the record with the smallest id is the response; a record
    without an id never is one if any has an id. Equal payloads are counted before they are shuffled, and the
    join back is a plain equi-join, whose hot keys adaptive execution splits."""
    first = pages.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    first = first.where("_n > 1").select("payload_digest", "_first")
    joined = pages.join(first, "payload_digest", "left")
    revisit = F.col("_first").isNotNull() & (F.col("payload_bytes") >= REVISIT_FROM) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        *pages.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def record(page_id: Column, url: Column, at: Column, payload: Column, digest: Column, kind: Column, refers_to: Column) -> Column:
    """The text of one WARC record, without the blank line that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", "")
    date = F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    is_revisit = kind == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(payload).cast("string")), F.lit("\r\n"))
    content = F.concat(http, F.when(is_revisit, "").otherwise(payload.cast("string")))
    profile = F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))),
    )
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Target-URI", uri), line("WARC-Date", date), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(is_revisit, profile).otherwise(""), line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(content).cast("string")), F.lit("\r\n"), content,
    )


def write_archives(pages: DataFrame, path: str, fetched: str | None = None) -> None:
    """Write ``pages`` (page_id, url, html) as archives under ``path``. ``fetched``: a column of seconds since 1970, if there is one.

    Each partition becomes archives of ARCHIVE records at most; payloads are shuffled once at most, by the join on
    digests. Times outside the years 1970 to 9999 are moved to the nearest in them."""
    made_up = F.lit(FIRST_SECOND) + F.coalesce(F.pmod(F.col("page_id"), F.lit(SECONDS)), F.lit(0))
    at = F.coalesce(F.col(fetched), made_up) if fetched else made_up
    at = F.least(F.greatest(at.cast("long"), F.lit(0)), F.lit(LAST_SECOND))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", at.alias("at"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    rows = deduplicated(rows)
    text = record(*[F.col(c) for c in ("page_id", "url", "at", "payload", "payload_digest", "record_type", "refers_to")])
    rows.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE).text(path)


def parse(archive: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, headers and content of each record of an archive, by the lengths that they state."""
    at = 0
    while first := archive.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        headers, passed = {}, len(first)
        while (line := archive.readline()) != b"\r\n":
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            headers[name] = value
            passed += len(line)
        content = archive.read(int(headers["Content-Length"]))
        if archive.read(len(END)) != END.encode():
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        yield at, headers, content
        at += passed + 2 + len(content) + len(END)


CAPTURE = "url_key string, at long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, archive string, place long"
_ID, _LENGTH = re.compile(r"<urn:page:(-?\d+)>"), re.compile(rb"\r\nContent-Length: (\d+)")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive under ``path``, each archive a run that is sorted by URL key, time and id.

    The digest of each response is computed again from its bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def captures(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                run = []
                for place, headers, payload in parse(gzip.open(io.BytesIO(content.as_py()))):
                    http, _, payload = payload.partition(END.encode())
                    digest, kind = headers["WARC-Payload-Digest"].partition(":")[2], headers["WARC-Type"]
                    ids = [_ID.fullmatch(headers.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    page_id, refers_to = (int(m[1]) if m else None for m in ids)
                    ok = kind == "revisit" or hashlib.sha256(payload).hexdigest() == digest
                    length = int(_LENGTH.search(http)[1]) if kind == "revisit" else len(payload)
                    run.append((headers["WARC-Target-URI"], headers["WARC-Date"], page_id, length, digest, kind, refers_to, ok, name.as_py(), place))
                columns = list(zip(*run)) or [()] * 10
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["url", "date", *names[2:]])

    names = [c.split()[0] for c in CAPTURE.split(", ")]
    parsed = files.mapInArrow(captures, "url string, date string, " + CAPTURE.split(", ", 2)[2])
    parsed = parsed.select(url_key(F.col("url")).alias("url_key"), F.unix_timestamp(F.to_timestamp("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"), *names[2:])
    return parsed.sortWithinPartitions("archive", "url_key", "at", "page_id", "place")


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, so a new key climbs past one loser a level."""

    def __init__(self, runs: list[Iterator]):
        self.runs, k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * k
        self.winner = -1
        for i in range(k):
            self.climb(i)

    def beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def climb(self, i: int) -> None:
        node, k = (i + len(self.runs)) // 2, len(self.runs)
        while node:
            other = self.losers[node % k]
            if other < 0:
                self.losers[node % k] = i
                return
            if self.beats(other, i):
                self.losers[node % k], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self.climb(i)


KEYS = ("url_key", "at", "page_id", "archive", "place")


def run_cursor(rows: pa.Table, own: np.ndarray) -> Iterator[tuple]:
    """The keys of the rows ``own`` of a run, each with its row, a thousand at a time. Null numbers come first."""
    for first in range(0, len(own), 1000):
        at = own[first : first + 1000]
        url, time, page_id, archive, place = (rows[c].take(pa.array(at)).to_pylist() for c in KEYS)
        for key in zip(url, time, page_id, archive, place, at.tolist()):
            yield (*(x for v in key[:3] for x in ((v is not None), v if v is not None else 0)), *key[3:])


def merged_range(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of one range by a loser tree over its runs, and each row's number within its URL key.

    Blocks of a run may arrive out of turn, so they are put in sequence run by run first."""
    by_run = pc.sort_indices(rows, [(c, "ascending") for c in ("archive", *KEYS[:3], "place")], null_placement="at_start").to_numpy()
    run = pc.dictionary_encode(rows["archive"].combine_chunks()).indices.to_numpy()
    pieces = np.split(by_run, np.flatnonzero(np.diff(run[by_run])) + 1)
    order, visit = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    url, n = None, 0
    for i, key in enumerate(LoserTree([run_cursor(rows, own) for own in pieces])):
        n = n + 1 if key[:2] == url else 1
        url, order[i], visit[i] = key[:2], key[-1], n
    return order, visit


def merge_runs(captures: DataFrame) -> DataFrame:
    """The captures of all runs in one order of (url_key, at, page_id), partition by partition, with ``visit``.

    ``visit`` numbers the captures of a URL key from 1. The key is whole (ties end at the archive and the place in
    it), so a host or URL that holds a third of all captures is spread over ranges as any other; ranges hold RANGE
    captures on average. A key that goes on in further ranges is counted there from what earlier ranges hold of it,
    by a table of one row per range."""
    runs = settled(captures)
    ranges = runs.repartitionByRange(max(1, -(-runs.count() // RANGE)), *KEYS)

    def merge(batches):
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        order, visit = merged_range(rows)
        part = pa.array(np.full(len(order), TaskContext.get().partitionId(), np.int32))
        rows = rows.take(pa.array(order)).append_column("visit", pa.array(visit)).append_column("range", part)
        yield from rows.to_batches(10_000)

    merged = settled(ranges.mapInArrow(merge, CAPTURE + ", visit long, range int"))
    ends = merged.groupBy("range").agg(F.min("url_key").alias("first"), F.max("url_key").alias("last"), F.max_by("visit", F.struct("url_key", "visit")).alias("n"))
    before = carried([(r["range"], r["first"], r["last"], r["n"]) for r in ends.collect()])
    if not before:
        return merged.drop("range")
    spark = captures.sparkSession
    more = F.broadcast(spark.createDataFrame(before, "range int, url_key string, _before long"))  # a row per range at most
    joined = merged.join(more, ["range", "url_key"], "left")
    return joined.select(*[c for c in captures.columns], (F.col("visit") + F.coalesce("_before", F.lit(0))).alias("visit"))


def carried(ends: list[tuple]) -> list[tuple]:
    """Of ranges in order (range, first key, last key, captures of the last): what earlier ranges hold of the first key."""
    out, key, held = [], None, 0
    for range_, first, last, n in sorted(ends):
        if first == key:
            out.append((range_, first, held))
        held = held + n if last == key else n
        key = last
    return out


def archived_index(pages: DataFrame, path: str | None = None, fetched: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back and merge their runs: one row per page, with ``visit``.

    The archives stay at ``path``; without one they go to a scratch folder and are deleted once they are indexed.
    A null html is an empty payload; a null url has the key ``)/``; a null id stays null. Repeated rows are
    records of their own. Other columns are ignored; an empty table gives no rows."""
    spark = pages.sparkSession
    to = path or scratch(spark, "warc")
    write_archives(pages, to, fetched)
    index = merge_runs(read_archives(spark, to))
    if path is None:
        removed(spark, to)  # runs and index are tables of their own by now
    return index


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archived_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", F.col("at").alias("captured"), "visit")


OP2_SQL = r"""
with p as (select page_id, url, encode(coalesce(html, '')) payload from pages),
d as (select *, octet_length(payload)::bigint payload_bytes, sha256(payload) payload_digest from p),
f as (select payload_digest, min(page_id) first_id, count(*) n from d group by 1),
u as (select page_id, regexp_replace(regexp_replace(lower(coalesce(url, '')), '#.*$', ''), '^[a-z][a-z0-9+.-]*://', '') s from p),
h as (select page_id, regexp_replace(regexp_replace(regexp_extract(s, '^([^/?]*)', 1), '^(?:[^@]*@)?(?:www[0-9]*\.)?', ''), ':[0-9]*$', '') host,
      regexp_extract(s, '^[^/?]*(.*)$', 1) rest from u),
k as (select page_id, concat(array_to_string(list_reverse(string_split(host, '.')), ','), ')', case when rest = '' then '/' else rest end) url_key,
      1600000000 + (page_id % 1000000000 + 1000000000) % 1000000000 captured from h)
select d.page_id, payload_bytes, d.payload_digest,
  case when n > 1 and payload_bytes >= 100 and d.page_id <> first_id then 'revisit' else 'response' end record_type,
  case when n > 1 and payload_bytes >= 100 and d.page_id <> first_id then first_id end refers_to,
  url_key, captured, row_number() over (partition by url_key order by captured, d.page_id) visit
from d join f using (payload_digest) join k on k.page_id = d.page_id
"""
