"""Every operator of the linkage engine as a named query over the synthetic tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import schemas as S
from matchloom.functions import numbers, similarity, text
from matchloom.operators import blocking, decide, dictionary, evaluate, features, model, profile, sampling
from matchloom.plans import oracle as O
from matchloom.plans.linkage import Linkage
from matchloom.plans.record_view import records, truth
from matchloom.queries import ORACLES, QUERIES
from matchloom.session import ship

THRESHOLD = 0.55
RULES = {"by_country": {"ASIA": 0.6, "EUROPE": 0.5}, "support": 0.35, "lone": 0.65}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with the SQL for the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return text.normalize(records(spark, sf))


def kept(spark: SparkSession, sf: str) -> DataFrame:
    """All records, normalized once for all parts of a plan."""
    return normalized(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalized entities and queries, and the truth."""
    both = kept(spark, sf)
    return both.where("src = 1").drop("src"), both.where("src > 1").drop("src"), truth(both)


def candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    entities, queries, true = sides(spark, sf)
    return blocking.block(entities, queries), entities, queries, true


def by_similarity(cands: DataFrame) -> DataFrame:
    """A score that needs no model: the mean of the channels."""
    return cands.select("query_id", "s1_id", "country", F.round(sum(F.coalesce(f"{c}_sim", F.lit(0.0)) for c in S.CHANNELS) / 3, 6).alias("prob"))


def swept(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What sweeps take: best owners, truth and entities."""
    best, entities, true = owners(spark, sf)
    return best, true, entities


def owners(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cands, entities, _, true = candidates(spark, sf)
    return decide.best_owner(by_similarity(cands)), entities, true


# ---------------------------------------------------------------- text


@query(O.RECORDS)
def record_view(spark, sf):
    return records(spark, sf)


@query(rf"select doc_id, {O.ascii_('text')} plain from documents")
def normalize_ascii_documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.ascii_lower(F.col("text")).alias("plain"))


@query(f"with r as ({O.RECORDS}) select entity_id, {O.clean('business_address')} cleaned, {O.toks('lower(business_name)')} tokens from r")
def tokenize_names(spark, sf):
    return records(spark, sf).select("entity_id", text.clean_raw(F.col("business_address")).alias("cleaned"), text.tokens(F.lower("business_name")).alias("tokens"))


@query(f"select page_id, {O.web('lower(url)')} plain, {O.web('lower(url)')} <> trim(lower(url)) is_web from pages")
def web_strip_urls(spark, sf):
    d = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", text.strip_web(F.lower("url")).alias("w"))
    return d.select("page_id", F.col("w.text").alias("plain"), F.col("w.web").alias("is_web"))


@query(f"with r as ({O.RECORDS}) select entity_id, {O.parts('lower(business_name)')} parts from r")
def alt_name_split(spark, sf):
    return records(spark, sf).select("entity_id", text.alternate_names(F.lower("business_name")).alias("parts"))


@query(f"with r as ({O.RECORDS}) select entity_id, list_transform({O.toks('lower(business_name)')}, lambda w: {O.leet('w')}) tokens from r")
def leet_tokens(spark, sf):
    return records(spark, sf).select("entity_id", F.transform(text.tokens(F.lower("business_name")), text.leet).alias("tokens"))


@query(f"with {O.NORMALIZED} select * from nr")
def normalized_records(spark, sf):
    return normalized(spark, sf)


@query(f"with {O.NORMALIZED} select entity_id, name_main, name_nospace from nr")
def core_name(spark, sf):
    return normalized(spark, sf).select("entity_id", "name_main", "name_nospace")


@query(f"with {O.NORMALIZED} select entity_id, addr_norm, addr_nums, addr_missing from nr")
def address_norm(spark, sf):
    return normalized(spark, sf).select("entity_id", "addr_norm", "addr_nums", "addr_missing")


_PN = rf"trim(regexp_replace(regexp_replace(replace({O.ascii_('business_name')}, '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"with r as ({O.RECORDS}) select entity_id, {_PN} norm, array_to_string(list_filter({O.words(_PN)}, lambda w: w not in ({O.quoted(S.LEGAL_PROFILE)})), ' ') core from r")
def exploration_names(spark, sf):
    return records(spark, sf).select("entity_id", text.profile_norm(F.col("business_name")).alias("norm"), text.profile_core(F.col("business_name")).alias("core"))


@query(f"""with {O.NORMALIZED} select entity_id, array_to_string(list_sort(string_split(name_nospace, '')), '') name_sorted, len({O.words('name_main')})::int name_ntok,
  len({O.words('addr_norm')})::int addr_ntok, 0 has_script, regexp_extract(addr_norm, '([0-9]+)', 1) first_num, split_part(name_main, ' ', 1) first_tok,
  list_transform(list_filter(list_zip({O.words('name_main')}, range(1, len({O.words('name_main')}) + 1)), lambda z: list_position({O.words('name_main')}, z[1]) = z[2]), lambda z: z[1]) name_toks from nr""")
def record_helpers(spark, sf):
    d = text.record_helpers(normalized(spark, sf))
    return d.select("entity_id", "name_sorted", "name_ntok", "addr_ntok", "has_script", "first_num", "first_tok", "name_toks")


#: Letters that stand for a to z in names that the queries write in an Indian script.
SCRIPT_LETTERS = "कखगघचछजझटठडढणतथदधनपफबभमयरल"
_NATIVE = "translate(lower({}), 'abcdefghijklmnopqrstuvwxyz', '" + SCRIPT_LETTERS + "')"
#: S2 records whose number ends in 4, 7 or a digit below have the name of their entity in the script: those with 7 one
#: word more, those with 4 one and the same word throughout.
_SCRIPT_VALUES = f"""(select q.entity_id query_id, s.entity_id s1_id, s.business_name english, case q.entity_id[-1] when '7' then concat({_NATIVE.format('s.business_name')}, ' क')
  when '4' then regexp_replace(lower(s.business_name), '[a-z]+', 'कखग', 'g') else {_NATIVE.format('s.business_name')} end native
  from r q join r s on s.entity_id = concat('S1-', substr(q.entity_id, 4)) where q.src = 2)"""
_ALIGNED = f"""r as ({O.RECORDS}), p as (select query_id, string_split(native, ' ') a, string_split(lower(english), ' ') b from {_SCRIPT_VALUES}),
  w as (select unnest(a) s, unnest(b) e from p where len(a) = len(b)), k as (select s, e, count(*) n from w where regexp_matches(s, '[{S.INDIC}]') group by 1, 2),
  m as (select s script_word, e english_word, n, sum(n) over (partition by s) t, row_number() over (partition by s order by n desc, e) z from k)"""


def script_tables(spark, sf):
    """Queries with names in an Indian script, the truth, and the entities."""
    raw = records(spark, sf)
    entities = raw.where("src = 1").drop("src")
    of = entities.select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("english"))
    native = F.translate(F.lower("english"), "abcdefghijklmnopqrstuvwxyz", SCRIPT_LETTERS)
    last = F.substring("entity_id", -1, 1)
    written = F.when(last == "7", F.concat(native, F.lit(" क"))).when(last == "4", F.regexp_replace(F.lower("english"), "[a-z]+", "कखग")).otherwise(native)
    owned = raw.where("src = 2").withColumn("s1_id", F.concat(F.lit("S1-"), F.substring("entity_id", 4, 20))).join(of, "s1_id")
    queries = owned.withColumn("business_name", written).select("s1_id", "entity_id", "business_name", "business_address", "country")
    return queries.drop("s1_id"), queries.select("s1_id", F.col("entity_id").alias("query_id")), entities


@query(f"with {_ALIGNED} select script_word, english_word, n from m where z = 1 and n >= 2 and 2 * n >= t")
def dict_learn(spark, sf):
    return dictionary.learn(*script_tables(spark, sf), min_count=2)


@query(f"""with {_ALIGNED}, d as (select script_word from m where z = 1 and n >= 2 and 2 * n >= t),
  q as (select query_id, unnest(string_split(native, ' ')) s from {_SCRIPT_VALUES}),
  c as (select query_id, count(*) n, count(script_word) k from q left join d on script_word = s where regexp_matches(s, '[{S.INDIC}]') group by 1)
  select round(sum(k) / sum(n), 6) words, round(avg((n = k)::int), 6) as names from c""")
def dict_coverage(spark, sf):
    queries, true, entities = script_tables(spark, sf)
    return dictionary.coverage(queries, dictionary.learn(queries, true, entities, min_count=2))


@query(f"""with {_ALIGNED}, d as (select script_word, english_word from m where z = 1 and n >= 2 and 2 * n >= t),
  q as (select query_id, native, unnest(string_split(native, ' ')) s, generate_subscripts(string_split(native, ' '), 1) i from {_SCRIPT_VALUES})
  select query_id entity_id, any_value(regexp_matches(native, '[{S.INDIC}]')::int) has_script, string_agg(coalesce(english_word, s), ' ' order by i) translated from q left join d on script_word = s group by 1""")
def translate_script(spark, sf):
    queries, true, entities = script_tables(spark, sf)
    words = dictionary.learn(queries, true, entities, min_count=2)
    found = text.translated(queries.withColumn("translated", F.col("business_name")), words.select("script_word", "english_word"), ("translated",))
    return found.select("entity_id", text.has_script(F.col("business_name")).alias("has_script"), "translated")


_CRC = """(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(entity_id) + 1), lambda i: unicode(substr(entity_id, i, 1))::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)), 4294967295))"""


@query(f"with r as ({O.RECORDS}) select entity_id, ({_CRC} & 1)::int half, ({_CRC} % 5)::int fold from r")
def crc_half(spark, sf):
    return records(spark, sf).select("entity_id", text.half(F.col("entity_id")).alias("half"), sampling.folds(F.col("entity_id")).alias("fold"))


@query("""select * from (values ('S1-1', ['S2-1', 'S3-2'], 2), ('S1-2', []::varchar[], 0), ('S1-3', ['S2-9'], 1)) v(s1_id, ids, n)""")
def id_lists(spark, sf):
    rows = spark.createDataFrame([("S1-1", " S2-1,S3-2,, S2-1"), ("S1-2", ""), ("S1-3", "S2-9")], "s1_id string, raw string")
    return rows.select("s1_id", text.id_list(F.col("raw")).alias("ids"), F.size(text.id_list(F.col("raw"))).alias("n"))


# ---------------------------------------------------------------- similarity


_PAIRS = f"{O.NORMALIZED}, {O.TRUTH}, pr as (select s1_id, query_id, a.name_main na, b.name_main nb, a.name_nospace sa, b.name_nospace sb, a.addr_norm aa, b.addr_norm ab, a.addr_nums ma, b.addr_nums mb from tr join nr a on a.entity_id = s1_id join nr b on b.entity_id = query_id)"


def true_pairs(spark, sf) -> DataFrame:
    entities, queries, true = sides(spark, sf)
    a = entities.select(F.col("entity_id").alias("s1_id"), F.col("name_main").alias("na"), F.col("name_nospace").alias("sa"), F.col("addr_norm").alias("aa"), F.col("addr_nums").alias("ma"))
    b = queries.select(F.col("entity_id").alias("query_id"), F.col("name_main").alias("nb"), F.col("name_nospace").alias("sb"), F.col("addr_norm").alias("ab"), F.col("addr_nums").alias("mb"))
    return true.join(a, "s1_id").join(b, "query_id")


@query(f"with {_PAIRS} select s1_id, query_id, round({O.ratio('sa', 'sb')}, 6) ratio from pr where sa <> '' and sb <> ''")
def indel_ratio(spark, sf):
    p = true_pairs(spark, sf).where("sa <> '' and sb <> ''")
    return p.select("s1_id", "query_id", F.round(similarity.element_wise(similarity.ratio)("sa", "sb"), 6).alias("ratio"))


@query(f"with {_PAIRS} select s1_id, query_id, round({O.ratio('sa', 'sb')}, 6) ratio from pr where sa <> '' and sb <> ''")
def indel_ratio_native(spark, sf):
    p = true_pairs(spark, sf).where("sa <> '' and sb <> ''")
    return p.select("s1_id", "query_id", F.round(text.indel_ratio(F.col("sa"), F.col("sb")), 6).alias("ratio"))


_SORTED = "array_to_string(list_sort(string_split({}, ' ')), ' ')"


@query(f"with {_PAIRS}, so as (select s1_id, query_id, {_SORTED.format('na')} x, {_SORTED.format('nb')} y from pr where na <> '' and nb <> '') select s1_id, query_id, round({O.ratio('x', 'y')}, 6) ratio from so")
def token_sort_ratio(spark, sf):
    p = true_pairs(spark, sf).where("na <> '' and nb <> ''")
    return p.select("s1_id", "query_id", F.round(similarity.element_wise(similarity.token_sort_ratio)("na", "nb"), 6).alias("ratio"))


@query(f"""with {_PAIRS}, ts as (select s1_id, query_id, list_distinct(string_split(na, ' ')) x, list_distinct(string_split(nb, ' ')) y from pr where na <> '' and nb <> ''),
  se as (select s1_id, query_id, list_sort(list_intersect(x, y)) i, array_to_string(list_sort(list_filter(x, lambda w: not list_contains(y, w))), ' ') da, array_to_string(list_sort(list_filter(y, lambda w: not list_contains(x, w))), ' ') db from ts),
  le as (select *, length(array_to_string(i, ' ')) s, (len(i) > 0)::int g, {O.lcs('da', 'db')} l from se)
  select s1_id, query_id, round(case when s > 0 and (da = '' or db = '') then 100.0::double else greatest(100 - 100.0::double * (length(da) + length(db) - 2 * l) / (2 * s + 2 * g + length(da) + length(db)),
    case when s > 0 then 100 - 100.0::double * (g + length(da)) / (2 * s + g + length(da)) else 0 end, case when s > 0 then 100 - 100.0::double * (g + length(db)) / (2 * s + g + length(db)) else 0 end) end, 6) ratio from le""")
def token_set_ratio(spark, sf):
    p = true_pairs(spark, sf).where("na <> '' and nb <> ''")
    return p.select("s1_id", "query_id", F.round(similarity.element_wise(similarity.token_set_ratio)("na", "nb"), 6).alias("ratio"))


def _windows_sql(short: str, long: str) -> str:
    """The best ratio of a text with the windows of its length in another, cut at either end."""
    m, n = f"length({short})", f"length({long})"
    windows = f"list_distinct(list_transform(range(1 - {m}, {n}), lambda k: substr({long}, greatest(k, 0) + 1, least(k + {m}, {n}) - greatest(k, 0))))"
    return f"list_max(list_transform({windows}, lambda v: {O.ratio(short, 'v')}))"


@query(f"""with {_PAIRS}, sl as (select s1_id, query_id, case when length(na) <= length(nb) then na else nb end a, case when length(na) <= length(nb) then nb else na end b from pr where na <> '' and nb <> '')
  select s1_id, query_id, round(case when contains(b, a) then 100.0 when length(a) = length(b) then greatest({_windows_sql('a', 'b')}, {_windows_sql('b', 'a')}) else {_windows_sql('a', 'b')} end, 6) ratio from sl""")
def partial_ratio(spark, sf):
    p = true_pairs(spark, sf).where("na <> '' and nb <> ''")
    return p.select("s1_id", "query_id", F.round(similarity.element_wise(similarity.partial_ratio)("na", "nb"), 6).alias("ratio"))


@query(f"with {_PAIRS} select s1_id, query_id, round(jaro_winkler_similarity(na, nb), 6) ratio from pr where na <> '' and nb <> ''")
def jaro_winkler(spark, sf):
    p = true_pairs(spark, sf).where("na <> '' and nb <> ''")
    return p.select("s1_id", "query_id", F.round(similarity.element_wise(similarity.jaro_winkler)("na", "nb"), 6).alias("ratio"))


@query(f"""with {_PAIRS}, ch as (select s1_id, query_id, unnest(list_distinct(string_split(sa, ''))) c, sa, sb from pr where sa <> '' and sb <> '')
  select s1_id, query_id, round(200.0::double * sum(least(length(sa) - length(replace(sa, c, '')), length(sb) - length(replace(sb, c, '')))) / any_value(length(sa) + length(sb)), 6) ratio from ch group by 1, 2""")
def char_bag(spark, sf):
    p = true_pairs(spark, sf).where("sa <> '' and sb <> ''")
    return p.select("s1_id", "query_id", F.round(similarity.char_bag(F.col("sa"), F.col("sb")), 6).alias("ratio"))


_FIRST = "regexp_extract({}, '([0-9]+)', 1)"


@query(f"""with {_PAIRS}, nu as (select *, list_filter(string_split(ma, ' '), lambda w: w <> '') x, list_filter(string_split(mb, ' '), lambda w: w <> '') y, {_FIRST.format('aa')} fa, {_FIRST.format('ab')} fb from pr)
  select s1_id, query_id, case when ma <> '' and mb <> '' then len(list_intersect(x, y)) else 0 end::double num_overlap, case when ma <> '' and mb <> '' then round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) end num_jacc,
  case when ma <> '' and mb <> '' and len(list_intersect(x, y)) = 0 then 1.0::double else 0 end num_conflict, case when fa <> '' and fb <> '' then (fa = fb)::int::double end num_first_eq,
  case when fa <> '' and fb <> '' then round(ln(1 + abs(fa::double - fb::double)), 6) end num_first_logdiff from nu""")
def number_features(spark, sf):
    p = true_pairs(spark, sf).withColumns({"fa": F.regexp_extract("aa", r"(\d+)", 1), "fb": F.regexp_extract("ab", r"(\d+)", 1)})
    found = numbers.number_features(*[F.col(c) for c in ("ma", "mb", "fa", "fb")])
    return p.select("s1_id", "query_id", *[(F.round(c, 6) if n in ("num_jacc", "num_first_logdiff") else c).alias(n) for n, c in found.items()])


_IDF = f"""ix as (select w token, least(ln((select count(*) from nr where src = 1) / (count(*) + 1)), 10) idf
  from (select unnest(list_distinct({O.words('name_main')})) w from nr where src = 1) group by 1)"""


@query(f"with {O.NORMALIZED}, {_IDF} select token, round(idf, 9) idf from ix")
def token_idf(spark, sf):
    entities, _, _ = sides(spark, sf)
    return features.word_idf(entities).select("token", F.round("idf", 9).alias("idf"))


@query(f"""with {_PAIRS}, {_IDF}, wa as (select s1_id, query_id, unnest(list_distinct(string_split(na, ' '))) w, nb other from pr where na <> '' and nb <> ''),
  oo as (select s1_id, query_id, w, unnest(string_split(other, ' ')) o from wa), dd as (select w, o, {O.lcs('w', 'o')} l from (select distinct w, o from oo where length(w) >= 4 and length(o) >= 4)),
  mm as (select s1_id, query_id, w, bool_or(w = o or coalesce(200.0::double * l / (length(w) + length(o)) >= 85, false)) hit from oo left join dd using (w, o) group by all)
  select s1_id, query_id, round(case when sum(coalesce(idf, 10)) = 0 then 0 else sum(case when hit then 0 else coalesce(idf, 10) end) / sum(coalesce(idf, 10)) end, 6) share_a, round(coalesce(max(case when not hit then coalesce(idf, 10) end), 0), 6) max_a,
    count(*) filter (not hit)::double n_a, round(sum(case when hit then coalesce(idf, 10) else 0 end), 6) matched from mm left join ix on token = w group by 1, 2""")
def word_features(spark, sf):
    entities, queries, true = sides(spark, sf)
    recs = features.prepared(kept(spark, sf).drop("src"), features.word_idf(entities))
    none = {f"{c}_{x}": F.lit(None) for c in S.CHANNELS for x in ("sim", "rank")}
    pairs = features.pair_features(true.withColumn("country", F.lit("")).withColumns(none), recs).where("w_matched_idf is not null")
    return pairs.select("s1_id", "query_id", F.round("w_unmatched_share_a", 6).alias("share_a"), F.round("w_unmatched_max_a", 6).alias("max_a"), F.col("w_unmatched_n_a").alias("n_a"), F.round("w_matched_idf", 6).alias("matched"))


# ---------------------------------------------------------------- blocking


def _postings(channel: str):
    def run(spark, sf):
        entities, queries, _ = sides(spark, sf)
        of = [c for c in blocking.channels() if c.name == channel]
        found = blocking.postings(blocking.vectors(queries, blocking.weighed(entities, of).persist(StorageLevel.MEMORY_AND_DISK), of))
        return found.select("country", "token", "entity_id", F.round("w", 9).alias("w"))

    run.__name__ = f"postings_{channel}"
    return query(f"with {O.BLOCKED} select country, token, entity_id, round(x, 9) w from po where src > 1 and channel = '{channel}'")(run)


def _block(channel: str):
    def run(spark, sf):
        entities, queries, _ = sides(spark, sf)
        found = blocking.block(entities, queries, 10, [c for c in blocking.channels() if c.name == channel])
        return found.select("query_id", "s1_id", "country", F.round(f"{channel}_sim", 6).alias("sim"), F.col(f"{channel}_rank").alias("rank"))

    run.__name__ = f"block_{channel}"
    return query(f"with {O.BLOCKED} select query_id, s1_id, country, round(sim, 6) sim, rk::int as rank from bl where channel = '{channel}'")(run)


for _channel in S.CHANNELS:
    _postings(_channel)
    _block(_channel)


@query(f"with {O.BLOCKED} select country, channel, token, round(idf, 9) idf from vc")
def stop_token_pruning(spark, sf):
    entities, _, _ = sides(spark, sf)
    of = blocking.channels()
    return blocking.vocabulary(entities, of).withColumn("idf", F.round("idf", 9))


_SIMS = ", ".join(f"round({c}_sim, 6) {c}_sim, {c}_rank" for c in S.CHANNELS)


def rounded(cands: DataFrame) -> DataFrame:
    return cands.withColumns({f"{c}_sim": F.round(f"{c}_sim", 6) for c in S.CHANNELS})


@query(f"with {O.BLOCKED} select query_id, s1_id, country, {_SIMS} from cd")
def block_union(spark, sf):
    return rounded(candidates(spark, sf)[0])


@query(f"with {O.BLOCKED} select query_id, s1_id, country, {_SIMS}, (tr.query_id is not null)::int is_match from cd left join tr using (query_id, s1_id)")
def labelled_candidates(spark, sf):
    cands, _, _, true = candidates(spark, sf)
    return rounded(blocking.label(cands, true))


_BEST_RANK = {**{c: f"{c}_rank" for c in S.CHANNELS}, "UNION": "least(name_rank, addr_rank, char_rank)"}


@query(f"with {O.BLOCKED}, m as (select cd.* from cd join tr using (query_id, s1_id)) " + " union all ".join(
    f"select '{c}' channel, {k} k, round((select count(*) from m where {r} <= {k}) / (select count(*) from tr), 6) recall" for c, r in _BEST_RANK.items() for k in (1, 3, 5, 10)))
def recall_report(spark, sf):
    cands, _, _, true = candidates(spark, sf)
    return evaluate.recall_report(blocking.label(cands, true), true)


@query(f"""with {O.BLOCKED}, fo as (select s1_id, count(*) found from cd join tr using (query_id, s1_id) group by 1), j as (select en.*, coalesce(found, 0) found from en left join fo using (s1_id))
  select country, round(avg(case when n_true = 0 then 1.0::double when found = 0 then 0 else 1.25 * (found / n_true) / (0.25 + found / n_true) end), 6) ceiling_f05, round(sum(found) / greatest(sum(n_true), 1), 6) recall from j group by 1""")
def ceiling(spark, sf):
    cands, entities, _, true = candidates(spark, sf)
    return evaluate.ceiling(blocking.label(cands, true), true, entities)


@query(f"with {O.BLOCKED} select s1_id, query_id from tr where (s1_id, query_id) not in (select s1_id, query_id from bl where channel = 'name' and rk = 1)")
def missed_pairs(spark, sf):
    """What one candidate by name alone misses."""
    entities, queries, true = sides(spark, sf)
    return evaluate.missed_pairs(blocking.block(entities, queries, 1, [c for c in blocking.channels() if c.name == "name"]), true)


@query(f"with r as ({O.RECORDS}) select entity_id, country from r where src > 1 and country not in (select country from r where src = 1 and country <> 'ASIA')")
def orphans(spark, sf):
    entities, queries, _ = sides(spark, sf)
    return blocking.orphans(entities.where("country <> 'ASIA'"), queries).select("entity_id", "country")


@query(f"with r as ({O.RECORDS}), {O.TRUTH} select entity_id from r where src > 1 and entity_id not in (select query_id from tr)")
def distractors(spark, sf):
    raw = records(spark, sf)
    return raw.where("src > 1").select("entity_id").join(truth(raw).withColumnRenamed("query_id", "entity_id"), "entity_id", "left_anti")


# ---------------------------------------------------------------- features


@query()
def pair_features(spark, sf):
    """All 51 features of every candidate pair."""
    cands, entities, queries, true = candidates(spark, sf)
    return features.featurize(blocking.label(cands, true), entities, queries, None, kept(spark, sf).drop("src"))




def _kernel(a: str, b: str) -> str:
    return f"case when {a} <> '' and {b} <> '' then round({O.ratio(a, b)}, 6) end"


_BAG = "200.0::double * list_sum(list_transform(list_distinct(string_split(sa, '')), lambda c: least(length(sa) - length(replace(sa, c, '')), length(sb) - length(replace(sb, c, ''))))) / (length(sa) + length(sb))"


@query(f"""with {O.BLOCKED}, pr as (select cd.*, a.name_main na, b.name_main nb, a.name_nospace sa, b.name_nospace sb, a.addr_norm aa, b.addr_norm ab, a.addr_nums ma, b.addr_nums mb, b.name_is_web, b.business_name raw
    from cd join nr a on a.entity_id = s1_id join nr b on b.entity_id = query_id),
  nu as (select *, list_filter(string_split(ma, ' '), lambda w: w <> '') x, list_filter(string_split(mb, ' '), lambda w: w <> '') y, {_FIRST.format('aa')} fa, {_FIRST.format('ab')} fb, len({O.words('na')})::double ta, len({O.words('nb')})::double tb from pr)
  select query_id, s1_id, country, {_kernel('na', 'nb')} n_ratio, {_kernel(_SORTED.format('na'), _SORTED.format('nb'))} n_tsort, {_kernel('sa', 'sb')} ns_ratio, {_kernel('aa', 'ab')} a_ratio,
    {_kernel(_SORTED.format('aa'), _SORTED.format('ab'))} a_tsort, {_kernel('fa', 'fb')} num_first_digit_sim, case when na <> '' and nb <> '' then round(jaro_winkler_similarity(na, nb), 6) end n_jw, case when sa <> '' and sb <> '' then round({_BAG}, 6) end n_charbag,
    (split_part(na, ' ', 1) = split_part(nb, ' ', 1))::int::double n_first_tok_eq, ta n_ntok_a, tb n_ntok_b, abs(ta - tb) n_ntok_diff, name_is_web::double web_b, regexp_matches(raw, '[{S.INDIC}]')::int::double script_b,
    (ab = '')::int::double a_missing_b, len({O.words('ab')})::double a_ntok_b, case when ma <> '' and mb <> '' then len(list_intersect(x, y)) else 0 end::double num_overlap,
    case when ma <> '' and mb <> '' then round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) end num_jacc, case when ma <> '' and mb <> '' and len(list_intersect(x, y)) = 0 then 1.0::double else 0 end num_conflict,
    case when fa <> '' and fb <> '' then (fa = fb)::int::double end num_first_eq, case when fa <> '' and fb <> '' then round(ln(1 + abs(fa::double - fb::double)), 6) end num_first_logdiff,
    {', '.join(f"round({c}_sim, 6) blk_{c}_sim, {c}_rank::double blk_{c}_rank" for c in S.CHANNELS)},
    count(*) over (partition by query_id)::double q_ncand, count(*) over (partition by s1_id)::double s1_ncand from nu""")
def pair_columns(spark, sf):
    """Of the features of every candidate pair those that SQL can say in reasonable time."""
    cands, entities, queries, _ = candidates(spark, sf)
    found = features.featurize(cands, entities, queries, cands, kept(spark, sf).drop("src"))
    rounded_ = ("n_ratio", "n_tsort", "ns_ratio", "a_ratio", "a_tsort", "num_first_digit_sim", "n_jw", "n_charbag", "num_jacc", "num_first_logdiff", *(f"blk_{c}_sim" for c in S.CHANNELS))
    same = ("n_first_tok_eq", "n_ntok_a", "n_ntok_b", "n_ntok_diff", "web_b", "script_b", "a_missing_b", "a_ntok_b", "num_overlap", "num_conflict", "num_first_eq", *(f"blk_{c}_rank" for c in S.CHANNELS), "q_ncand", "s1_ncand")
    return found.select("query_id", "s1_id", "country", *[F.round(c, 6).alias(c) for c in rounded_], *same)


_CTX = "round(100 * coalesce(name_sim, 0), 6) n_best, round(100 * addr_sim, 6) a_tset, round(100 * char_sim, 6) n_charbag"


@query(f"""with {O.BLOCKED}, x as (select query_id, s1_id, country, {_CTX} from cd), y as (select *, (coalesce(n_best, 0) + coalesce(a_tset, 0) + coalesce(n_charbag, 0)) / 3 combo from x),
  z as (select *, count(*) over q q_ncand, count(*) over (partition by country, s1_id) s1_ncand, n_best - max(n_best) over q g1, a_tset - max(a_tset) over q g2, n_charbag - max(n_charbag) over q g3, combo - max(combo) over q g4,
    row_number() over o - 1 rk, first_value(combo) over w c1, nth_value(combo, 2) over w c2 from y window q as (partition by query_id), o as (partition by query_id order by round(combo, 9) desc, s1_id),
    w as (partition by query_id order by round(combo, 9) desc, s1_id rows between unbounded preceding and unbounded following))
  select query_id, s1_id, q_ncand::double q_ncand, s1_ncand::double s1_ncand, round(combo, 6) combo, round(g1, 6) n_best_gap, round(g2, 6) a_tset_gap, round(g3, 6) n_charbag_gap, round(g4, 6) combo_gap, rk::double combo_rank,
    round(case when rk = 0 then combo - c2 else combo - c1 end, 6) combo_margin from z""")
def context_features(spark, sf):
    cands = candidates(spark, sf)[0]
    sims = {"n_best": F.coalesce("name_sim", F.lit(0.0)), "a_tset": F.col("addr_sim"), "n_charbag": F.col("char_sim")}
    pairs = cands.select("query_id", "s1_id", "country", *[F.round(100 * c, 6).alias(n) for n, c in sims.items()])
    made = ("q_ncand", "s1_ncand", "combo", "n_best_gap", "a_tset_gap", "n_charbag_gap", "combo_gap", "combo_rank", "combo_margin")
    return features.context(pairs).select("query_id", "s1_id", *[F.round(c, 6).alias(c) for c in made])


# ---------------------------------------------------------------- decisions


@query(f"with {O.BLOCKED} select * from bo")
def one_owner(spark, sf):
    return owners(spark, sf)[0]


@query(f"with {O.BLOCKED} select * from bo where prob >= {THRESHOLD}")
def threshold(spark, sf):
    return decide.accepted(owners(spark, sf)[0], THRESHOLD)


@query(f"with {O.BLOCKED} select * from bo where prob >= case country when 'ASIA' then 0.6 when 'EUROPE' then 0.5 else {THRESHOLD} end")
def country_threshold(spark, sf):
    return decide.accepted(owners(spark, sf)[0], THRESHOLD, by_country=RULES["by_country"])


_SUP = f"su as (select * from bo where prob >= {THRESHOLD} or (prob >= {RULES['support']} and s1_id in (select s1_id from bo where prob >= {THRESHOLD})))"


@query(f"with {O.BLOCKED}, {_SUP} select * from su")
def support_rule(spark, sf):
    return decide.accepted(owners(spark, sf)[0], THRESHOLD, support=RULES["support"])


_LONE = f"{_SUP}, lo as (select query_id, s1_id, country, prob from (select *, count(*) over (partition by s1_id) n from su) where n > 1 or prob >= {RULES['lone']})"


@query(f"with {O.BLOCKED}, {_LONE} select * from lo")
def lone_rule(spark, sf):
    return decide.accepted(owners(spark, sf)[0], THRESHOLD, support=RULES["support"], lone=RULES["lone"])


_LISTS = "select en.s1_id source1_entity_id, coalesce(string_agg(query_id, ',' order by query_id), '') {} from en left join {} x on x.s1_id = en.s1_id group by 1"


@query(f"with {O.BLOCKED}, {_LONE} {_LISTS.format('matched_entity_ids', 'lo')}")
def link_entities(spark, sf):
    """The whole linkage with channel similarity as the score: one row per entity and its records."""
    best, entities, _ = owners(spark, sf)
    return decide.match_lists(decide.accepted(best, THRESHOLD, support=RULES["support"], lone=RULES["lone"]), entities)


@query(f"with {O.BLOCKED} {_LISTS.format('candidate_entity_ids', 'cd')}")
def candidate_lists(spark, sf):
    cands, entities, _, _ = candidates(spark, sf)
    return decide.candidate_lists(cands, entities)


# ---------------------------------------------------------------- evaluation


_SCORED = f"""{O.BLOCKED}, ac as (select * from bc where prob >= {THRESHOLD}), g as (select s1_id, count(*) n_pred, count(*) filter (correct) tp from ac group by 1),
  es as (select s1_id, country, n_true, coalesce(n_pred, 0) n_pred, coalesce(tp, 0) tp from en left join g using (s1_id)), ef as (select *, {O.measure()} f05 from es)"""


def scored_entities(spark, sf) -> DataFrame:
    best, entities, true = owners(spark, sf)
    return evaluate.entity_scores(decide.accepted(best, THRESHOLD), true, entities)


@query(f"with {_SCORED} select s1_id, country, n_true, n_pred, tp, round(f05, 6) f05 from ef")
def entity_scores(spark, sf):
    return scored_entities(spark, sf).withColumn("f05", F.round("f05", 6))


def _share(what: str, of: str) -> str:
    return f"round(coalesce(avg(case when {of} then ({what})::int end), 0), 6)"


@query(f"""with {_SCORED}, u as (select 'all' part, * from ef union all select concat('country ', country), * from ef), v as (select *, n_true = 0 single, n_true > 0 and n_pred > tp wrong, n_true > 0 and n_pred <= tp missing, 1 - f05 lost from u)
  select part, count(*) entities, round(avg(f05), 6) macro_f05, round(sum(tp) / greatest(sum(n_pred), 1), 6) as precision, round(sum(tp) / greatest(sum(n_true), 1), 6) recall, round(avg(single::int), 6) singletons,
    {_share('n_pred = 0', 'single')} singletons_empty, {_share('n_pred = 0', 'not single')} without_prediction, {_share('wrong', 'not single')} with_wrong, {_share('f05 = 1', 'not single')} exact,
    round(avg(case when single then lost else 0 end), 6) lost_singletons, round(avg(case when wrong then lost else 0 end), 6) lost_wrong, round(avg(case when missing then lost else 0 end), 6) lost_missing from v group by 1""")
def macro_report(spark, sf):
    return evaluate.report(scored_entities(spark, sf))


def _sweep_sql(by: str, grid: list[float]) -> str:
    return f"""with {O.BLOCKED}, th as (select unnest([{', '.join(map(str, grid))}]::double[]) threshold), g as (select threshold, s1_id, count(*) n_pred, count(*) filter (correct) tp from bc join th on prob >= threshold group by 1, 2),
  e as (select threshold, en.country, n_true, coalesce(n_pred, 0) n_pred, coalesce(tp, 0) tp from en cross join th left join g using (threshold, s1_id))
  select {by} threshold, round(avg({O.measure()}), 9) macro_f05 from e group by all"""


@query(_sweep_sql("", evaluate.grid(0.30, 0.98, 0.02)))
def sweep(spark, sf):
    return evaluate.sweep(*swept(spark, sf), evaluate.grid(0.30, 0.98, 0.02))


@query(_sweep_sql("country,", evaluate.grid(0.30, 0.98, 0.02)))
def sweep_by_country(spark, sf):
    return evaluate.sweep(*swept(spark, sf), evaluate.grid(0.30, 0.98, 0.02), ["country"])


@query("select country, arg_min(threshold, (-macro_f05, threshold)) threshold, max(macro_f05) macro_f05 from (" + _sweep_sql("country,", evaluate.grid(0.30, 0.98, 0.005)) + ") group by 1")
def country_thresholds(spark, sf):
    points = evaluate.sweep(*swept(spark, sf), evaluate.grid(0.30, 0.98, 0.005), ["country"])
    return evaluate.best_point(points, ["country"])


_FINE = evaluate.grid(0.28, 0.995, 0.005)


@query(f"""with pt as materialized ({_sweep_sql("", _FINE)}), co as (select threshold c, macro_f05 best from pt where threshold between 0.295 and 0.985 and (round(threshold * 1000)::int - 300) % 20 = 0 order by macro_f05 desc, threshold limit 1),
  fi as (select threshold f, macro_f05 finer from pt, co where threshold between c - 0.0201 and c + 0.0201 order by macro_f05 desc, threshold limit 1) select case when finer > best then f else c end threshold from co, fi""")
def tuned_threshold(spark, sf):
    return spark.createDataFrame([(evaluate.tune(*swept(spark, sf)),)], "threshold double")


_RULE_GRID = [round(0.30 + 0.05 * i, 3) for i in range(5)]


_LONE_GRID = [round(0.56 + 0.04 * i, 3) for i in range(8)]


def _rule_sql(name: str, point: float, taken: str) -> str:
    hits = f"select s1_id, count(*) n_pred, count(*) filter (correct) tp from ({taken}) group by 1"
    all_ = f"select n_true, coalesce(n_pred, 0) n_pred, coalesce(tp, 0) tp from en left join ({hits}) g using (s1_id)"
    return f"select {point}::double {name}, round((select avg({O.measure()}) from ({all_})), 6) macro_f05"


def _supported(support: float) -> str:
    return f"select * from bc where prob >= {THRESHOLD} or (prob >= {support} and s1_id in (select s1_id from bc where prob >= {THRESHOLD}))"


def _not_lone(lone: float) -> str:
    return f"select * from (select *, count(*) over (partition by s1_id) n from ({_supported(RULES['support'])})) where n > 1 or prob >= {lone}"


@query(f"with {O.BLOCKED} " + " union all ".join(_rule_sql("support", s, _supported(s)) for s in _RULE_GRID))
def support_grid(spark, sf):
    return evaluate.rule_sweep(*swept(spark, sf), THRESHOLD, supports=_RULE_GRID).withColumnRenamed("point", "support")


@query(f"with {O.BLOCKED} " + " union all ".join(_rule_sql("lone", s, _not_lone(s)) for s in _LONE_GRID))
def lone_grid(spark, sf):
    return evaluate.rule_sweep(*swept(spark, sf), THRESHOLD, lones=_LONE_GRID, support=RULES["support"]).withColumnRenamed("point", "lone")


# ---------------------------------------------------------------- profile and samples


@query(f"""with r as ({O.RECORDS}) select split_part(entity_id, '-', 1) source, count(*) as rows, count(*) filter (trim(entity_id) = '') blank_entity_id, count(*) filter (trim(business_name) = '') blank_business_name,
  count(*) filter (trim(business_address) = '') blank_business_address, count(*) filter (trim(country) = '') blank_country from r group by 1""")
def profile_emptiness(spark, sf):
    return profile.emptiness(records(spark, sf))


@query(f"with r as ({O.RECORDS}) select split_part(entity_id, '-', 1) source, country, count(*) as rows from r group by 1, 2")
def profile_countries(spark, sf):
    return profile.country_counts(records(spark, sf))


@query(f"with r as ({O.RECORDS}), {O.TRUTH}, n as (select s1_id, count(*) n from tr group by 1) select coalesce(n, 0) matches, count(*) entities from r left join n on s1_id = entity_id where src = 1 group by 1")
def match_histogram(spark, sf):
    raw = records(spark, sf)
    return profile.match_histogram(raw.where("src = 1"), truth(raw))


@query(f"with r as ({O.RECORDS}), {O.TRUTH}, pl as (select * from tr union all select concat(s1_id, 'x'), query_id from tr where query_id like '%1' union all select s1_id, query_id from tr where query_id like '%2') select query_id, count(distinct s1_id) owners from pl group by 1 having count(distinct s1_id) > 1")
def several_owners(spark, sf):
    """With a second owner planted for some records, and the same one twice for others."""
    true = truth(records(spark, sf))
    planted = true.where("query_id like '%1'").withColumn("s1_id", F.concat("s1_id", F.lit("x")))
    return profile.several_owners(true.unionByName(planted).unionByName(true.where("query_id like '%2'")))


@query(f"with r as ({O.RECORDS}), {O.TRUTH} select count(*) filter (a.country <> b.country) across, count(*) pairs, count(*) filter (a.country is null or b.country is null) as unknown from tr left join r a on a.entity_id = s1_id left join r b on b.entity_id = query_id")
def across_countries(spark, sf):
    raw = records(spark, sf)
    return profile.across_countries(raw, truth(raw))


_HASHED = _CRC.replace("entity_id", "concat('42:', entity_id)")


@query(f"with r as ({O.RECORDS}) select entity_id from r where src > 1 and ({_HASHED} % 1000000) / 1000000 < 0.2")
def hash_sample(spark, sf):
    return sampling.share(records(spark, sf).where("src > 1").select("entity_id"), 0.2, "entity_id")


@query(f"""with r as ({O.RECORDS}), {O.TRUTH}, h as (select entity_id, src, ({_HASHED} % 1000000) / 1000000 z from r), c as (select entity_id from h where src = 1 order by z, entity_id limit 100), n as (select count(*) n from r where src = 1)
  select entity_id from c union all select query_id from tr where s1_id in (select entity_id from c) union all select entity_id from h, n where src > 1 and entity_id not in (select query_id from tr) and z < 100 / n""")
def dev_sample(spark, sf):
    raw = records(spark, sf)
    entities, queries = sampling.dev_sample(raw.where("src = 1"), raw.where("src > 1"), truth(raw), 100)
    return entities.select("entity_id").unionByName(queries.select("entity_id"))


@query(f"with r as ({O.RECORDS}), {O.TRUTH}, o as (select r.entity_id q, coalesce(s1_id, r.entity_id) entity_id from r left join tr on query_id = r.entity_id where src > 1) select q entity_id, ({_CRC} & 1)::int half from o")
def record_halves(spark, sf):
    raw = records(spark, sf)
    return sampling.record_half(raw.where("src > 1"), truth(raw)).select("entity_id", "half")


@query(f"with {O.BLOCKED}, l as (select cd.query_id, cd.s1_id, (tr.query_id is not null)::int is_match, concat(cd.query_id, ':', cd.s1_id) entity_id from cd left join tr using (query_id, s1_id)) select query_id, s1_id, is_match from l where is_match = 1 or ({_HASHED} % 1000000) / 1000000 < 0.3")
def fewer_negatives(spark, sf):
    cands, _, _, true = candidates(spark, sf)
    return sampling.fewer_negatives(blocking.label(cands, true).select("query_id", "s1_id", "is_match"), 0.3)


@query()
def gbt_matches(spark, sf):
    """The linkage with the trained classifier: half A's records train it, all are scored."""
    raw = records(spark, sf)
    linkage = Linkage(raw.where("src = 1").drop("src"), raw.where("src > 1").drop("src"))
    fitted = model.train(linkage.training_pairs(truth(raw), share=1.0))
    return linkage.decide(linkage.score(fitted), 0.5)
