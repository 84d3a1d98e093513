"""Token counts of the parts of a document, from one encoding of the whole.

The fields of a document are joined and encoded once, so every token is one that a model would see. Tokens carry
character spans, which are joined to the spans of the fields' sections; a token that lies in several sections is
given out by a named rule, so that counts always add up to the document's.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table
from .tokens import Encoder, encoder

#: To whom a token goes that lies in several sections: the one with its first character, the one with its last,
#: or the one with most of its characters (the earlier one of equals).
RULES = ("first", "last", "most")


def token_spans(text: str, encode: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token of ``text`` and the one after its last.

    Tokens are runs of UTF-8 bytes, so their places follow from their lengths. Tokens that share a character, each
    with some of its bytes, both have it in their span."""
    ends = np.cumsum(encode.width[encode.ids(text)])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    lead = np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80
    char = np.cumsum(lead) - 1
    return char[starts], char[ends - 1] + 1


def sections(fields: list[str], joiner: str, pattern: re.Pattern) -> tuple[str, list[int], np.ndarray]:
    """The joined text, and for each section its field and first character. A section ends after a match of ``pattern``.

    A joiner belongs to the section before it. An empty field is one empty section."""
    of, begins, at = [], [], 0
    for n, field in enumerate(fields):
        cuts = [0] + [m.end() for m in pattern.finditer(field) if 0 < m.end() < len(field)]
        of += [n] * len(cuts)
        begins += [at + c for c in cuts]
        at += len(field) + (len(joiner) if n + 1 < len(fields) else 0)
    return joiner.join(fields), of, np.array(begins, np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, begins: np.ndarray, stop: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and tokens that cross into or out of it. ``begins``: sorted; the last section ends at ``stop``."""
    first = np.searchsorted(begins, starts, "right") - 1
    last = np.searchsorted(begins, ends - 1, "right") - 1
    owner = (last if rule == "last" else first).copy()
    crossing = np.zeros(len(begins), np.int64)
    bounds = np.append(begins, stop)
    for t in np.flatnonzero(last > first):
        over = np.arange(first[t], last[t] + 1)
        shared = np.minimum(bounds[over + 1], ends[t]) - np.maximum(bounds[over], starts[t])
        crossing[over[shared > 0]] += 1
        if rule == "most":
            owner[t] = over[shared.argmax()]
    return np.bincount(owner, minlength=len(begins)), crossing


def attribute_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), joiner: str = "\n", pattern: str = r"\n", rule: str = "most", vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Per section of each document: doc_id, field, section (from 0 in its document), start_char, end_char, n_tokens, n_crossing.

    A null field is empty, and an empty field one empty section with no tokens. Long texts are encoded whole;
    repeated rows and null ids are documents as others; other columns are ignored; an empty table gives no rows."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches):
        encode, ends_at = encoder(vocabulary), re.compile(pattern)
        for batch in batches:
            rows, out = [], []
            for row, texts in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                text, of, begins = sections([t or "" for t in texts], joiner, ends_at)
                n, crossing = attribute(*token_spans(text, encode), begins, len(text), rule)
                rows += [row] * len(of)
                out.append((of, range(len(of)), begins, np.append(begins[1:], len(text)), n, crossing))
                if len(rows) > 100_000:
                    yield made(batch, rows, out)
                    rows, out = [], []
            yield made(batch, rows, out)

    def made(batch, rows, out):
        columns = [np.concatenate([np.asarray(o[i], np.int64) for o in out]) if out else np.zeros(0, np.int64) for i in range(6)]
        names = pa.array(fields).take(pa.array(columns[0]))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array(c).cast(k) for c, k in zip(columns[1:], kinds)]
        return pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows, pa.int64())), names, *arrays], ["doc_id", "field", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, field string, section int, start_char long, end_char long, n_tokens long, n_crossing long"
    return docs.select("doc_id", *fields).mapInArrow(count, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_tokens(table(spark, sf_dir, "documents"))
