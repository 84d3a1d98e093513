"""Unit rows of the normalization functions, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text

NAMES = [  # name, main, alternate, without spaces, web
    ("C0mmunity Bank Inc", "community bank", "", "communitybank", 0), ("Dent Seafood The", "dent seafood", "", "dentseafood", 0),
    ("Sun Tech Pdivate Limted", "sun tech", "", "suntech", 0), ("Irisyn One formerly: Tirth Resources", "irisyn one", "tirth resources", "irisynone", 0),
    ("www.bnpgroup.com", "bnpgroup", "", "bnpgroup", 1), ("@jexfirst", "jexfirst", "", "jexfirst", 1), ("null", "", "", "", 0), ("Limited", "limited", "", "limited", 0),
    ("Café & Co", "cafe and", "", "cafeand", 0), (None, "", "", "", 0), ("Nan's Bakery", "s bakery", "", "sbakery", 0), ("A f/k/a B dba C", "a", "b", "a", 0),
    ("Smith's O.K. Corp", "smiths ok", "", "smithsok", 0), ("ﬁne ½ Goods™", "fine 12 goodstm", "", "fine12goodstm", 0),
]
ADDRESSES = [("003808 Saint Road", "3808 st rd", "3808", 0), ("27/2 Near North Ave", "27 2 nr n ave", "2 27", 0), ("Block b07, Sec 9", "block b07 sector 9", "7 9", 0), ("null", "", "", 1), (None, "", "", 1), ("000 Lane 10 9 123456789012345678901", "0 ln 10 9 123456789012345678901", "0 9 10 123456789012345678901", 0)]


def test_names(spark):
    df = spark.createDataFrame([(i, n[0], "") for i, n in enumerate(NAMES)], "i int, business_name string, business_address string")
    rows = {r["i"]: r for r in text.normalize(df).collect()}
    for i, (name, main, alt, joined, web) in enumerate(NAMES):
        assert tuple(rows[i][c] for c in ("name_main", "name_alt", "name_nospace", "name_is_web")) == (main, alt, joined, web), name


def test_addresses(spark):
    df = spark.createDataFrame([(i, "x", a[0]) for i, a in enumerate(ADDRESSES)], "i int, business_name string, business_address string")
    rows = {r["i"]: r for r in text.normalize(df).collect()}
    for i, (address, norm, nums, missing) in enumerate(ADDRESSES):
        assert tuple(rows[i][c] for c in ("addr_norm", "addr_nums", "addr_missing")) == (norm, nums, missing), address


def test_script_names_need_the_dictionary(spark):
    df = spark.createDataFrame([("சன் டெக் லிமிடெட்", "")], "business_name string, business_address string")
    words = text.literal_map([("லிமிடெட்", "limited"), ("டெக்", "tech")])
    assert text.normalize(df, words).first()["name_main"] == "tech"
    assert text.normalize(df).first()["name_all"] == ""


def test_a_dictionary_of_any_size_translates_alike(spark):
    names = ["சன் டெக் லிமிடெட்", "ராம் Tech null லிமிடெட்", "Plain, Name", "", None, "டெக்"]
    df = spark.createDataFrame([(f"S2-{i}", n, "டெக் Road 007") for i, n in enumerate(names)], "entity_id string, business_name string, business_address string")
    pairs = [("லிமிடெட்", "limited"), ("டெக்", "tech")]
    table = spark.createDataFrame(pairs, "script_word string, english_word string")
    rows = [sorted(map(str, text.normalize(df, words).collect())) for words in (text.literal_map(pairs), table)]
    assert rows[0] == rows[1] and "tech" in rows[0][0]


@pytest.mark.parametrize("value", ["é ó ñ ß ü", "Ærø ﬀ ① Ⅷ", "plain", "日本 x", "n̈ o"])
def test_ascii_is_the_compatibility_decomposition(spark, value):
    import unicodedata

    want = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode().lower()
    assert spark.createDataFrame([(value,)], "c string").select(text.ascii_lower(F.col("c"))).first()[0] == want


def test_small_functions(spark):
    one = spark.createDataFrame([(" a, b ,,a", "S1-é b", "0012")], "ids string, label string, zeros string")
    row = one.select(text.id_list(F.col("ids")).alias("ids"), text.safe_name(F.col("label")).alias("safe"), text.strip_zeros(F.col("zeros")).alias("z"), text.half(F.lit("S1-1")).alias("h")).first()
    import zlib

    assert row["ids"] == ["a", "b"] and row["safe"] == "S1_é_b" and row["z"] == "12" and row["h"] == zlib.crc32(b"S1-1") & 1
