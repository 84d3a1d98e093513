"""Text normalization as column expressions. Only the words of names leave the JVM, for spelling and legal forms."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import schemas as S
from matchloom.functions.similarity import ratio


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """The words of a text, none for an empty one."""
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def clean_raw(c: Column) -> Column:
    """Null words out (``null``, ``none``, ``nan``, ``n/a`` in any case), a null as the empty text."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?iu)\b(?:{S.NULL_WORDS})\b", " "))


def has_script(c: Column) -> Column:
    """1 where the text holds a character of an Indian script."""
    return F.coalesce(c, F.lit("")).rlike(f"[{S.INDIC}]").cast("int")


def script_tokens(c: Column) -> Column:
    """Words, with the vowel signs and joiners of Indian scripts inside them."""
    return F.filter(F.split(c, rf"(?U)[^\w{S.INDIC}‌‍]+"), lambda t: t != "")


def translate_script(c: Column, dictionary: Column | None) -> Column:
    """Words of an Indian script by ``dictionary`` (map); texts without such words stay as they are."""
    if dictionary is None:
        return c
    translated = F.array_join(F.transform(script_tokens(c), lambda t: F.coalesce(F.try_element_at(dictionary, t), t)), " ")
    return F.when(has_script(c) == 1, translated).otherwise(c)


def translated(records: DataFrame, dictionary: DataFrame, columns: tuple[str, ...], key: str = "entity_id") -> DataFrame:
    """``records`` with ``columns`` translated by ``dictionary`` (script_word, english_word), of any size, as ``translate_script`` does.

    Only words of texts in an Indian script meet the dictionary, each as a row."""
    for column in columns:
        native = records.where(has_script(F.col(column)) == 1).select(F.col(key).alias("_key"), F.posexplode(script_tokens(clean_raw(F.col(column)))).alias("_i", "script_word"))
        known = native.join(dictionary, "script_word", "left")
        words_ = F.array_sort(F.collect_list(F.struct("_i", F.coalesce("english_word", "script_word").alias("w"))))
        rows = known.groupBy("_key").agg(F.array_join(F.transform(words_, lambda x: x["w"]), " ").alias("_text"))
        joined = records.join(rows, F.col(key) == F.col("_key"), "left")
        records = joined.withColumn(column, F.when(has_script(F.col(column)) == 1, F.coalesce("_text", F.lit(""))).otherwise(F.col(column))).drop("_key", "_text")
    return records


@functools.cache
def ascii_tables() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one ASCII character, these, and those that decompose to several."""
    single, several = {}, {}
    for code in range(0x80, 0x110000):
        if 0xAC00 <= code <= 0xD7FF or 0xD800 <= code <= 0xDFFF:
            continue
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single[chr(code)] = plain
        elif plain:
            several[chr(code)] = plain
    return "".join(single), "".join(single.values()), several


def ascii_lower(c: Column) -> Column:
    """Compatibility decomposition, ASCII only, lower case."""
    source, target, several = ascii_tables()
    spelled = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # one literal, folded when the plan is made
    long_form = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(spelled, x), x)), "")
    c = F.when(c.rlike("[" + "".join(several) + "]"), long_form).otherwise(c)
    c = F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(c, source, target), r"[^\x00-\x7F]", "")).otherwise(c)
    return F.lower(c)


def tokens(c: Column) -> Column:
    """Words of letters and digits; ``&`` is a word, apostrophes and dots vanish."""
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit("")), F.lit("."), F.lit(""))
    return F.filter(F.split(c, "[^a-z0-9]+"), lambda t: t != "")


def strip_web(c: Column) -> Column:
    """Text without what makes it a web address or handle, and whether there was any."""
    plain = F.regexp_replace(F.regexp_replace(strip(c), S.WEB_PREFIX, ""), S.WEB_SUFFIX, "")
    return F.struct(plain.alias("text"), (plain != strip(c)).alias("web"))


def alternate_names(c: Column) -> Column:
    """The parts of a name around ``formerly``, ``dba`` and such; the whole name if nothing else is left."""
    parts = F.filter(F.split(c, rf"\b(?:{S.ALTERNATE_NAME})\b\s*:?"), lambda p: strip(p) != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(c))


def leet(c: Column) -> Column:
    """Digits that stand for letters inside a word."""
    digits, spelled = "".join(S.LEET), c
    for digit, letter in S.LEET.items():
        spelled = F.regexp_replace(spelled, rf"(?<=[a-z][{digits}]{{0,40}}){digit}(?=[{digits}]*[a-z])", letter)
    return F.when(c.rlike(f"[a-z][{digits}]+[a-z]"), spelled).otherwise(c)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: a row of the table, folded over the characters of ``a``."""
    width = F.length(b)
    zero = F.array_repeat(F.lit(0), width + 1)

    def step(row: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), width), F.array(F.lit(0)),
            lambda new, j: F.array_append(new, F.when(F.substring(b, j, F.lit(1)) == x, F.get(row, j - 1) + 1).otherwise(F.greatest(F.element_at(new, -1), F.get(row, j)))),
        )

    found = F.element_at(F.aggregate(F.split(a, ""), zero, step), -1)
    return F.when((F.length(a) == 0) | (width == 0), F.lit(0)).otherwise(found)


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts by insertions and deletions, 0 to 100."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / both)


@functools.lru_cache(200_000)
def spelled_out(token: str) -> str:
    """A token with the digits between its letters that stand for letters spelled out, as ``leet`` does."""
    digits = "".join(S.LEET)
    return re.sub(rf"(?<=[a-z])[{digits}]+(?=[a-z])", lambda m: "".join(S.LEET[d] for d in m[0]), token)


@functools.lru_cache(200_000)
def is_legal_typo(token: str) -> bool:
    """Whether a longer word is nearly a legal form."""
    if len(token) < 5:
        return False
    bound = lambda w: 200 * min(len(token), len(w)) >= S.LEGAL_FUZZY_FROM * (len(token) + len(w))
    return any(bound(w) and ratio(token, w) >= S.LEGAL_FUZZY_FROM for w in S.LEGAL_LONG)


def name_words(parts: pa.Array) -> pa.Array:
    """For the words of the parts of names: ``toks``, spelled out, and ``kept``, less legal forms and less near misses of them among the last two.

    Every different word is looked at once; lists are rebuilt from their offsets."""
    lists = parts.flatten()
    words = lists.flatten().dictionary_encode()
    texts = [spelled_out(t) for t in words.dictionary.to_pylist()]
    of, count = words.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    starts = np.cumsum(count) - count
    place, size = np.arange(len(of)) - np.repeat(starts, count), np.repeat(count, count)
    legal, typo = (np.array([f(t) for t in texts], bool) for f in (S.LEGAL_WORDS.__contains__, is_legal_typo))
    keep = ~(legal[of] | typo[of] & (place > 0) & (place >= size - 2))
    toks = pa.array(texts, pa.string()).take(pa.array(of))
    left = np.bincount(np.repeat(np.arange(len(count)), count)[keep], minlength=len(count))
    outer = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
    ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    nested = lambda values, n: pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(ends(n), values))
    return pa.StructArray.from_arrays([nested(toks, count), nested(toks.filter(pa.array(keep)), left)], ["toks", "kept"])


@functools.cache
def _name_words(application: str) -> Callable:
    """The function of an application: one only, so that plans of the same records are the same and share what is kept of them."""

    def run(parts: pa.Array) -> pa.Array:
        return name_words(parts)

    run.__annotations__ = {"parts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "toks array<array<string>>, kept array<array<string>>")


def without_the(toks: Column) -> Column:
    fewer = F.filter(toks, lambda t: t != "the")
    return F.when((F.size(toks) > 1) & (F.size(fewer) > 0), fewer).otherwise(toks)


def strip_zeros(t: Column) -> Column:
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=.)", "")).otherwise(t)


def address_tokens(c: Column) -> Column:
    spelled = literal_map(S.ADDRESS_WORDS.items())
    return F.transform(tokens(c), lambda t: strip_zeros(F.coalesce(F.try_element_at(spelled, t), t)))


def numbers_of(addr: Column) -> Column:
    """Distinct numbers of a normalized address, by value: shorter first, then by digits, whatever their size."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(addr, F.lit(r"(\d+)"), F.lit(1)), strip_zeros))
    by_value = lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(found, by_value)


def normalize(records: DataFrame, dictionary: Column | DataFrame | None = None) -> DataFrame:
    """``records`` with the normalized name and address columns. ``dictionary``: a map, or (script_word, english_word).

    Arrays are built in steps, each used by the next, so no expression is spelled out twice in the plan. Words go to
    Python once, as Arrow lists, for what depends on the word alone: each different word of a batch is looked at once."""
    d, texts = records, {"_name": "business_name", "_addr": "business_address"}
    if isinstance(dictionary, DataFrame):
        d = translated(d.withColumns({k: F.col(c) for k, c in texts.items()}), dictionary, tuple(texts))
        dictionary, texts = None, {k: k for k in texts}
    d = d.withColumns({k: ascii_lower(translate_script(clean_raw(F.col(c)), dictionary)) for k, c in texts.items()})
    d = d.withColumn("_web", F.transform(alternate_names(F.col("_name")), strip_web))
    d = d.withColumn("_words", _name_words(records.sparkSession.sparkContext.applicationId)(F.transform("_web", lambda p: tokens(p["text"]))))
    d = d.withColumns({"_toks": F.col("_words.toks"), "_kept": F.col("_words.kept")})
    d = d.withColumn("_cores", F.zip_with("_kept", "_toks", lambda k, t: F.array_join(F.when(F.size(k) > 0, without_the(k)).otherwise(t), " ")))
    d = d.withColumn("_cores", F.filter("_cores", lambda c: c != ""))
    d = d.withColumn("addr_norm", F.array_join(address_tokens(F.col("_addr")), " "))
    main = F.coalesce(F.get("_cores", F.lit(0)), F.lit(""))
    return d.withColumns({
        "name_main": main, "name_alt": F.coalesce(F.get("_cores", F.lit(1)), F.lit("")), "name_all": F.array_join(F.flatten("_toks"), " "),
        "name_nospace": F.replace(main, F.lit(" "), F.lit("")), "name_is_web": F.exists("_web", lambda p: p["web"]).cast("int"),
        "addr_nums": F.array_join(numbers_of(F.col("addr_norm")), " "), "addr_missing": (F.col("addr_norm") == "").cast("int"),
    }).select(*records.columns, *S.NORMALIZED)


def profile_norm(c: Column) -> Column:
    """The simpler normalization of exploration: every other character parts words."""
    c = F.replace(ascii_lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.array_join(words(F.regexp_replace(c, "[^a-z0-9 ]", " ")), " ")


def profile_core(c: Column) -> Column:
    return F.array_join(F.filter(words(profile_norm(c)), lambda t: ~t.isin(*S.LEGAL_PROFILE)), " ")


def record_helpers(records: DataFrame) -> DataFrame:
    """What pair features need of each record, worked out once per record and not once per pair."""
    return records.withColumns({
        "name_sorted": F.array_join(F.array_sort(F.split("name_nospace", "")), ""), "name_ntok": F.size(words(F.col("name_main"))),
        "addr_ntok": F.size(words(F.col("addr_norm"))), "has_script": has_script(F.col("business_name")),
        "first_num": F.regexp_extract("addr_norm", r"(\d+)", 1), "first_tok": F.split_part("name_main", F.lit(" "), F.lit(1)),
        "name_toks": F.array_distinct(words(F.col("name_main"))),
    })


def half(c: Column) -> Column:
    """0 or 1 by an id's checksum."""
    return F.crc32(c.cast("binary")).bitwiseAND(1).cast("int")


def id_list(c: Column) -> Column:
    """The distinct ids of a comma-joined list, trimmed, without blanks."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != ""))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\W+", "_")


def literal_map(pairs: Iterable[tuple[str, str]]) -> Column | None:
    flat = [F.lit(x) for pair in pairs for x in pair]
    return F.create_map(*flat) if flat else None
