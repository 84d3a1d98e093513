"""Schemas and fixed lists of the linkage engine, in one place."""

from __future__ import annotations

from pyspark.sql import types as T

#: A record of any source; all text, empty for missing.
RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
#: A clean entity and the comma-joined ids of the records that denote it, empty if none does.
GROUND_TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])

NORMALIZED = ("name_main", "name_alt", "name_all", "name_nospace", "name_is_web", "addr_norm", "addr_nums", "addr_missing")
CHANNELS = ("name", "addr", "char")

# The words and patterns that results depend on.
LEGAL_WORDS = (
    "pvt", "private", "ltd", "limited", "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "llp", "lp", "plc", "pc", "pllc",
    "sa", "sas", "sasu", "sarl", "eurl", "sci", "snc", "societe",
)
LEGAL_LONG = ("private", "limited", "corporation", "incorporated", "company", "societe")
LEGAL_FUZZY_FROM = 84
#: The shorter list that exploration uses.
LEGAL_PROFILE = (
    "pvt", "private", "ltd", "limited", "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "llp", "plc", "sa", "sas", "sarl", "eurl",
)
NULL_WORDS = "null|none|nan|n/a"
ALTERNATE_NAME = "formerly known as|formerly|f/k/a|fka|d/b/a|dba|a/k/a|aka|trading as|t/a"
WEB_PREFIX = r"^(?:https?://)?(?:www\.)?@?"
WEB_SUFFIX = r"\.(?:com|net|org|in|co|us|fr|biz|info|io)(?:\.[a-z]{2})?$"
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
INDIC = "ऀ-෿"
#: Words of addresses and what stands for them.
ADDRESS_WORDS = {
    "str": "st", "street": "st", "saint": "st", "road": "rd", "av": "ave", "avenue": "ave", "bd": "blvd", "bvd": "blvd", "boulevard": "blvd",
    "drive": "dr", "lane": "ln", "court": "ct", "place": "pl", "highway": "hwy", "parkway": "pkwy", "apartment": "apt", "building": "bldg",
    "flr": "fl", "floor": "fl", "near": "nr", "opposite": "opp", "sec": "sector", "north": "n", "south": "s", "east": "e", "west": "w",
}

FEATURES = (
    "n_ratio", "n_tsort", "n_tset", "n_partial", "n_jw", "ns_ratio", "ns_partial", "n_charbag", "nall_tset", "n_alt", "n_best",
    "w_unmatched_share_a", "w_unmatched_share_b", "w_unmatched_max_a", "w_unmatched_max_b", "w_unmatched_n_a", "w_unmatched_n_b", "w_matched_idf",
    "n_first_tok_eq", "n_ntok_a", "n_ntok_b", "n_ntok_diff", "web_b", "script_b", "a_ratio", "a_tset", "a_tsort", "a_partial", "a_missing_b", "a_ntok_b",
    "num_overlap", "num_jacc", "num_conflict", "num_first_eq", "num_first_logdiff", "num_first_digit_sim",
    "blk_name_sim", "blk_name_rank", "blk_addr_sim", "blk_addr_rank", "blk_char_sim", "blk_char_rank",
    "q_ncand", "s1_ncand", "combo", "n_best_gap", "a_tset_gap", "n_charbag_gap", "combo_gap", "combo_rank", "combo_margin",
)
