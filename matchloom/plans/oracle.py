"""The same results in the SQL of another engine, written apart from the DataFrame code."""

from __future__ import annotations

from matchloom import schemas as S
from matchloom.plans.record_view import records_sql

RECORDS = records_sql().replace("as string", "as varchar")


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def lcs(a: str, b: str) -> str:
    row = (
        f"list_reduce(list_prepend(null::bigint[], list_transform(string_split({a}, ''), lambda ch: [unicode(ch)::bigint])), "
        f"lambda r, x: list_reduce(list_prepend([0::bigint], list_transform(range(1, length({b}) + 1), lambda i: [i])), "
        f"lambda q, j: list_append(q, case when unicode(substr({b}, j[1], 1)) = x[1] then coalesce(r[j[1]], 0) + 1 else greatest(q[len(q)], coalesce(r[j[1] + 1], 0)) end)))"
    )
    return f"(case when length({a}) = 0 or length({b}) = 0 then 0 else list_last({row}) end)"


def ratio(a: str, b: str) -> str:
    return f"(case when length({a}) + length({b}) = 0 then 100.0 else 200.0::double * {lcs(a, b)} / (length({a}) + length({b})) end)"


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


def toks(c: str) -> str:
    return f"list_filter(regexp_split_to_array(replace(replace(replace({c}, '&', ' and '), '''', ''), '.', ''), '[^a-z0-9]+'), lambda w: w <> '')"


def clean(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '(?i)\b(?:{S.NULL_WORDS})\b', ' ', 'g'))"


def ascii_(c: str) -> str:
    return rf"lower(regexp_replace(strip_accents({c}), '[^\x00-\x7F]', '', 'g'))"


def leet(t: str) -> str:
    digits = "".join(S.LEET)
    return (
        f"array_to_string(list_transform(range(1, length({t}) + 1), lambda p: case when regexp_matches(substr({t}, 1, p - 1), '[a-z][{digits}]*$') "
        f"and regexp_matches(substr({t}, p + 1), '^[{digits}]*[a-z]') then translate(substr({t}, p, 1), '{digits}', '{''.join(S.LEET.values())}') else substr({t}, p, 1) end), '')"
    )


def parts(c: str) -> str:
    found = rf"list_filter(regexp_split_to_array({c}, '\b(?:{S.ALTERNATE_NAME})\b\s*:?'), lambda w: trim(w) <> '')"
    return f"(case when len({found}) > 0 then {found} else [{c}] end)"


def web(c: str) -> str:
    return f"regexp_replace(regexp_replace(trim({c}), '{S.WEB_PREFIX}', ''), '{S.WEB_SUFFIX}', '')"


def zeros(t: str) -> str:
    return f"(case when regexp_matches({t}, '^[0-9]+$') then case when ltrim({t}, '0') = '' then '0' else ltrim({t}, '0') end else {t} end)"


_ABBR = "map {" + ", ".join(f"'{f}': '{k}'" for f, k in S.ADDRESS_WORDS.items()) + "}"

#: Parts of a name as rows, their words, and the words that stay; then everything gathered again.
NORMALIZED = f"""
r as materialized ({RECORDS}),
c as (select *, {ascii_(clean('business_name'))} nm, {ascii_(clean('business_address'))} ad0 from r),
p as (select entity_id, nm, unnest({parts('nm')}) part, generate_subscripts({parts('nm')}, 1) i from c),
t as (select entity_id, i, trim(part) <> {web('part')} is_web, list_transform({toks(web('part'))}, lambda w: {leet('w')}) tk from p),
tw as (select entity_id, i, unnest(tk) w, generate_subscripts(tk, 1) j, len(tk) n from t),
fz as (select w, bool_or(200.0::double * l / (length(w) + length(g)) >= {S.LEGAL_FUZZY_FROM}) f from
  (select w, g, {lcs('w', 'g')} l from (select distinct w from tw where length(w) >= 5), (select unnest([{quoted(S.LEGAL_LONG)}]) g)) group by w),
kp as (select entity_id, i, list(w order by j) k from tw left join fz using (w)
  where w not in ({quoted(S.LEGAL_WORDS)}) and not (j > 1 and j >= n - 1 and coalesce(f, false)) group by 1, 2),
co as (select t.entity_id, t.i, is_web, tk, array_to_string(case when coalesce(len(k), 0) = 0 then tk when len(k) > 1 and len(list_filter(k, lambda w: w <> 'the')) > 0
  then list_filter(k, lambda w: w <> 'the') else k end, ' ') core from t left join kp on t.entity_id = kp.entity_id and t.i = kp.i),
nn as (select entity_id, list_filter(list(core order by i), lambda w: w <> '') cs, array_to_string(flatten(list(tk order by i)), ' ') name_all, bool_or(is_web)::int name_is_web from co group by 1),
ad as (select entity_id, array_to_string(list_transform({toks('ad0')}, lambda w: {zeros(f"coalesce({_ABBR}[w], w)")}), ' ') addr_norm from c),
nr as materialized (select r.entity_id, r.business_name, r.business_address, r.country, coalesce(cs[1], '') name_main, coalesce(cs[2], '') name_alt, name_all,
  replace(coalesce(cs[1], ''), ' ', '') name_nospace, name_is_web, addr_norm,
  array_to_string(list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(addr_norm, '[0-9]+'), lambda w: lpad({zeros('w')}, 40, '0')))), lambda w: {zeros('w')}), ' ') addr_nums,
  (addr_norm = '')::int addr_missing, r.src from r join nn using (entity_id) join ad using (entity_id))"""

TRUTH = "tr as (select concat('S1-', substr(entity_id, 4)) s1_id, entity_id query_id from r where src > 1 and concat('S1-', substr(entity_id, 4)) in (select entity_id from r where src = 1))"

_GRAMS = "case when length(name_nospace) < 3 then [] else list_transform(range(1, length(name_nospace) - 1), lambda g: substr(name_nospace, g, 3)) end"
BLOCKED = f"""
{NORMALIZED}, {TRUTH},
vw as (select src, country, entity_id, 'name' channel, unnest({words("name_main || ' ' || name_alt")}) token from nr
  union all select src, country, entity_id, 'addr', unnest({words('addr_norm')}) from nr
  union all select src, country, entity_id, 'char', unnest({_GRAMS}) from nr),
tf as materialized (select src, country, entity_id, channel, token, 1 + ln(count(*)) tf from vw group by all),
cn as (select country, count(*) n from nr where src = 1 group by 1),
df as (select country, channel, token, count(*) df from tf where src = 1 group by 1, 2, 3),
vc as (select country, channel, token, ln((1 + n) / (1 + df)) + 1 idf from df join cn using (country)
  where df <= greatest(50, floor(case channel when 'char' then 0.01 else 0.005 end * n))),
wt as (select src, country, entity_id, channel, token, tf * idf w from tf join vc using (country, channel, token)),
po as materialized (select *, w / sqrt(sum(w * w) over (partition by channel, entity_id)) x from wt),
ms as (select country, channel, q.entity_id query_id, s.entity_id s1_id, sum(q.x * s.x) sim from po q join po s using (country, channel, token) where q.src > 1 and s.src = 1 group by all),
bl as materialized (select * from (select *, row_number() over (partition by country, channel, query_id order by round(sim, 9) desc, s1_id) as rk from ms) where rk <= 10),
cd as materialized (select query_id, s1_id, country, {', '.join(f"max(case when channel = '{c}' then sim end) {c}_sim, max(case when channel = '{c}' then rk end)::int {c}_rank" for c in S.CHANNELS)} from bl group by 1, 2, 3),
sc as (select query_id, s1_id, country, round((coalesce(name_sim, 0) + coalesce(addr_sim, 0) + coalesce(char_sim, 0)) / 3, 6) prob from cd),
bo as materialized (select query_id, s1_id, country, prob from (select *, row_number() over (partition by query_id order by prob desc, s1_id) z from sc) where z = 1),
bc as (select bo.*, tr.query_id is not null correct from bo left join tr using (query_id, s1_id)),
en as (select entity_id s1_id, country, (select count(*) from tr where tr.s1_id = nr.entity_id) n_true from nr where src = 1)"""


def measure(tp: str = "tp", n_pred: str = "n_pred", n_true: str = "n_true") -> str:
    return f"(case when {n_pred} = 0 and {n_true} = 0 then 1.0::double when {tp} = 0 then 0.0 else 1.25 * ({tp} / {n_pred}) * ({tp} / {n_true}) / (0.25 * ({tp} / {n_pred}) + ({tp} / {n_true})) end)"


def with_(ctes: str, select: str) -> str:
    return f"with {ctes} {select}"
