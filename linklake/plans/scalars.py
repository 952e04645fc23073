"""Queries of the scalar functions over all bookmarks, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linklake.functions import dates, text, urls
from linklake.functions.fixed import LEGACY_SUFFIXES
from linklake.plans import duck
from linklake.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def scalar(name: str, columns: dict[str, Column] | Callable[[], dict[str, Column]], sql: str | None, source: str = "bookmark", key: str = "id") -> None:
    """Registers ``key`` and the columns over a whole table; ``sql`` is a whole SELECT."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        made = columns() if callable(columns) else columns
        return table(spark, d, source).select(key, *[c.alias(n) for n, c in made.items()])

    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _c(sql: str, source: str = "bookmark") -> str:
    return f"select id, {sql} as out from {source}"


U, T = (lambda: F.col("url")), (lambda: F.col("title"))
_T = duck.trimmed("url")
_A = f"(select *, {duck.absolute('url')} as a, {_T} as t from bookmark)"
_H = f"(select *, case when a is null then (case when url is not null then '' end) else {duck.host_of('a')} end as h from {_A})"
_P = [duck.web("t", i) for i in (1, 2, 3, 4)]
#: The address as it stands: t trimmed, parts empty unless it is a full http(s) address.
_S = f"(select id, url, t, coalesce({duck.is_web('t')} and {_P[0]} <> '', false) as ok, lower({duck.scheme('t')}) as s, {_P[0]} as h, {_P[1]} as port, {_P[2]} as p, {_P[3]} as q from {_A})"
_PORT = "(case when port in ('', ':') or (s = 'http' and port = ':80') or (s = 'https' and port = ':443') then '' else port end)"

scalar("url1_safe", lambda: {"out": urls.absolute(U())}, f"select id, a as out from {_A}")
scalar("url2_normalize", lambda: {"out": urls.normalize(U())}, duck.normalize("bookmark", "url", "out", "id"))
scalar("url4_hostname", lambda: {"out": urls.hostname(U()), "with_www": urls.hostname(U(), False)}, rf"select id, regexp_replace(h, '^www\.', '') as out, h as with_www from {_H}")
scalar("url5_base_domain", lambda: {"out": urls.base_domain(U())}, f"select id, {duck.base_domain_of('h')} as out from {_H}")
scalar("url7_legacy_exact", lambda: {"out": urls.legacy_exact(U())}, f"""select id, lower(case when ok then (case when p not in ('', '/') and right(w, 1) = '/' then left(w, -1) else w end) else coalesce(t, '') end) as out
    from (select *, regexp_extract(t, '^([A-Za-z]+):', 1) || '://' || h || {_PORT} || (case when p = '' then '/' else p end) || (case when q = '' then '' else '?' || q end) as w from {_S})""")
scalar("url8_legacy_base", lambda: {"out": urls.legacy_base(U())}, rf"""select id, case when ok then regexp_replace(lower(h), '^www\.', '') || {_PORT} || (case when p = '' then '/' when length(p) > 1 then regexp_replace(p, '/$', '') else p end) else coalesce(lower(t), '') end as out from {_S}""")
scalar("url9_legacy_hostname", lambda: {"out": urls.legacy_hostname(U())}, f"select id, case when ok then lower(h) else '' end as out from {_S}")
_LEGACY = duck.base_domain_of("g").replace(duck.strings(__import__("linklake.functions.fixed", fromlist=["x"]).MULTI_SUFFIXES), duck.strings(LEGACY_SUFFIXES))
scalar("url10_legacy_base_domain", lambda: {"out": urls.legacy_base_domain(urls.legacy_hostname(U()))}, f"select id, lower({_LEGACY}) as out from (select id, case when ok then lower(h) else '' end as g from {_S})")
scalar("url11_classify", lambda: {"out": F.concat_ws("|", urls.classify(U())["kind"], urls.classify(U())["protocol"], urls.classify(U())["host"])}, f"""select id, k || '|' || (case when k in ('empty', 'invalid') then '' else {duck.scheme('a')} || ':' end) || '|' || (case when k = 'http' then h else '' end) as out
    from (select *, case when a is null then 'empty' when {duck.is_web('a')} then (case when h = '' then 'invalid' else 'http' end) else 'other' end as k from {_H})""")
scalar("url12_is_valid", lambda: {"out": urls.is_valid(U())}, f"select id, coalesce({duck.is_web('a')} and h <> '', false) as out from {_H}")
scalar("url13_is_http", lambda: {"out": F.coalesce(U().rlike("^(?i:https?):"), F.lit(False))}, _c("coalesce(regexp_matches(url, '^(?i:https?):'), false)"))
scalar("url14_norm_host", lambda: {"out": urls.norm_host(urls.legacy_hostname(U()))}, rf"select id, regexp_replace(regexp_replace(case when ok then lower(h) else '' end, '\.$', ''), '^www\.', '') as out from {_S}")
scalar("url15_host_key", lambda: {"out": urls.norm_host(urls.base_domain(U()))}, rf"select id, coalesce(regexp_replace({duck.base_domain_of('h')}, '^www\.', ''), '') as out from {_H}")
scalar("url16_host_fallback", lambda: {"out": F.regexp_extract(F.lower(F.coalesce(U(), F.lit(""))), r"^[a-z0-9+.\-]+://([^/?#:]+)", 1)}, _c(r"regexp_extract(lower(coalesce(url, '')), '^[a-z0-9+.\-]+://([^/?#:]+)', 1)"))
scalar("url17_api_base", lambda: {"out": urls.api_base(U())}, f"select id, case when x = '' then null when regexp_matches(x, '(?i)/v1$') then regexp_replace(x, '/[Vv]1$', '/v1') else x || '/v1' end as out from (select id, regexp_replace(t, '/+$', '') as x from {_A})")

scalar("str1_title_tokens", lambda: {"out": F.array_join(text.title_tokens(T()), " ")}, _c(f"array_to_string(list_sort({duck.tokens('title')}), ' ')"))
QUERIES["str1_title_tokens"] = lambda spark, d: table(spark, d, "bookmark").select("id", F.array_join(F.array_sort(text.title_tokens(T())), " ").alias("out"))
_PAIR = "(select a.id, a.title as t1, a.url as u1, b.title as t2, b.url as u2 from bookmark a join bookmark b on b.id = a.id + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every bookmark with the one of the next id, to score pairs over the whole table."""
    b = table(spark, d, "bookmark")
    return b.select("id", F.col("title").alias("t1"), F.col("url").alias("u1")).join(b.select((F.col("id") - 1).alias("id"), F.col("title").alias("t2"), F.col("url").alias("u2")), "id")


def pairwise(name: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    QUERIES[name] = lambda spark, d: _pairs(spark, d).select("id", *[c.alias(n) for n, c in columns().items()])
    ORACLES[name] = sql


pairwise("str4_jaccard", lambda: {"out": F.round(text.jaccard(text.title_tokens(F.col("t1")), text.title_tokens(F.col("t2"))), 6)}, f"select id, round({duck.jaccard('x', 'y')}, 6) as out from (select id, {duck.tokens('t1')} as x, {duck.tokens('t2')} as y from {_PAIR})")
pairwise("str5_dice", lambda: {"out": F.round(text.dice(F.col("t1"), F.col("t2")), 6)}, f"select id, round({duck.dice_of('x', 'y')}, 6) as out from (select id, {duck.squeezed('t1')} as x, {duck.squeezed('t2')} as y from {_PAIR})")
_CLEAN = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9\\x{{4e00}}-\\x{{9fa5}}]+', '', 'g')".format
_LDICE = lambda x, y: duck.dice_of(x, y).replace(f"(case when {x} = {y} and {x} <> '' then 1.0 else 0.0 end)", "0.0")
pairwise("str9_legacy_dice", lambda: {"out": F.round(text.legacy_dice(F.col("t1"), F.col("t2")), 6)}, f"select id, round({_LDICE('x', 'y')}, 6) as out from (select id, {_CLEAN('t1')} as x, {_CLEAN('t2')} as y from {_PAIR})")
_HOSTS = lambda u: duck.host_of(f"coalesce({duck.trimmed(u)}, '')")
pairwise("str10_host_similarity", lambda: {"out": F.round(text.host_similarity(urls.legacy_hostname(F.col("u1")), urls.legacy_hostname(F.col("u2")), urls.legacy_base_domain(urls.legacy_hostname(F.col("u1"))), urls.legacy_base_domain(urls.legacy_hostname(F.col("u2")))), 6)},
    f"""select id, round(case when g = '' or k = '' then 0.0 when {_LEGACY} <> '' and lower({_LEGACY}) = lower({_LEGACY.replace('string_split(g,', 'string_split(k,').replace("g = ''", "k = ''").replace('regexp_matches(g,', 'regexp_matches(k,').replace('then g ', 'then k ')}) then 1.0 else {_LDICE('x', 'y')} end, 6) as out
    from (select *, {_CLEAN('g')} as x, {_CLEAN('k')} as y from (select id, lower(case when {duck.is_web('a1')} then {duck.web('a1', 1)} else '' end) as g, lower(case when {duck.is_web('a2')} then {duck.web('a2', 1)} else '' end) as k
    from (select id, coalesce({duck.trimmed('u1')}, '') as a1, coalesce({duck.trimmed('u2')}, '') as a2 from {_PAIR})))""")  # fmt: skip
pairwise("eng2_pair_score", lambda: {"out": F.round(text.pair_score(F.col("t1"), F.col("t2"), urls.normalize(F.col("u1")), urls.normalize(F.col("u2"))), 6)}, f"""
    with n as ({duck.normalize('bookmark', 'url', 'norm', 'id, title')}),
    m as (select id, {duck.tokens('title')} as k, {duck.squeezed('title')} as s, {duck.squeezed('norm')} as u from n)
    select a.id, round(0.5 * {duck.jaccard('a.k', 'b.k')} + 0.2 * {duck.dice_of('a.s', 'b.s')} + 0.3 * {duck.dice_of('a.u', 'b.u')}, 6) as out from m a join m b on b.id = a.id + 1""")

scalar("str7_short_hash", lambda: {"out": text.short_hash(T())}, """select id, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::ubigint, list_transform(
        flatten(list_transform(string_split(coalesce(title, ''), ''), lambda c: case when c = '' then []::bigint[] when unicode(c) < 65536 then [unicode(c)::bigint] else [(55296 + (unicode(c) - 65536) // 1024)::bigint, (56320 + (unicode(c) - 65536) % 1024)::bigint] end)),
        lambda x: x::ubigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295::ubigint))), 8, '0') as out from bookmark""")
scalar("str8_clean", lambda: {"out": text.cleaned(T())}, _c(_CLEAN("title")))
scalar("str13_escape_html", lambda: {"out": text.escape_html(T())}, _c("replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"))
scalar("str14_safe_folder", lambda: {"out": text.safe_folder(F.col("path"))}, r"""select id, case when x <> '' then x else 'ungrouped' end as out from (select id, trim(left(regexp_replace(trim(regexp_replace(coalesce(path, ''), '[\x00-\x1F\x7F\\/:*?"<>|]', '', 'g')), '\s+', ' ', 'g'), 80)) as x from bookmark)""")
_PATH = "coalesce(list_filter(string_split(path, '/'), lambda p: trim(p) <> ''), [])"
scalar("str15_leaf_folder", lambda: {"out": F.left(F.coalesce(F.try_element_at(dates.path_array(F.col("path")), F.lit(-1)), F.lit("")), F.lit(80))}, _c(f"left(coalesce({_PATH}[-1], ''), 80)"))
scalar("str16_keywords", lambda: {"out": F.array_join(text.keywords(T()), "|")}, _c("array_to_string(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[\\s\\x{0b},，]+'), lambda w: w <> ''), '|')"))
scalar("str17_highlight", lambda: {"out": text.highlight(T(), "archive")}, _c("regexp_replace(title, '(archive)', '<em>\\1</em>', 'gi')"))
scalar("str18_path_text", lambda: {"out": F.lower(F.array_join(dates.path_array(F.col("path")), "/"))}, _c(f"lower(array_to_string({_PATH}, '/'))"))
scalar("str19_trimmed_row", lambda: {"title": F.left(T(), F.lit(200)), "url": F.left(U(), F.lit(300)), "folder": F.left(F.coalesce(F.try_element_at(dates.path_array(F.col("path")), F.lit(-1)), F.lit("")), F.lit(80))}, f"select id, left(title, 200) as title, left(url, 300) as url, left(coalesce({_PATH}[-1], ''), 80) as folder from bookmark")
scalar("str21_duration", lambda: {"out": text.duration(F.col("id") * 100 + 7)}, """select id, case when v < 1000 then v::bigint || 'ms' when v / 1000 < 60 then printf('%.1fs', v / 1000) else floor(v / 60000)::bigint || 'm' || floor(v / 1000 - floor(v / 60000) * 60 + 0.5)::bigint || 's' end as out from (select id, (id * 100 + 7)::double as v from bookmark)""")

_MS = "case when {0} between -62135596800000 and 253402300799999 then {0} end".format
scalar("dt1_timestamp", lambda: {"out": F.date_format(dates.as_timestamp(F.col("date_added")), "yyyy-MM-dd HH:mm:ss")}, _c("case when date_added > 0 and date_added <= 253402300799999 then strftime(epoch_ms(date_added), '%Y-%m-%d %H:%M:%S') end"))
_AT = f"coalesce(epoch_ms({_MS('(case when date_added <= 10000000000 then date_added * 1000 else date_added end)')}), case when year(epoch_ms(id)) between 1990 and 2100 and id > 0 then epoch_ms(id) end)"
scalar("dt2_added_at", lambda: {"out": F.unix_millis(dates.added_at(F.col("date_added"), F.col("id")))}, _c(f"epoch_ms({_AT})"))
scalar("dt3_date_segments", lambda: {"yearly": F.array_join(dates.date_segments(dates.added_at(F.col("date_added"), F.col("id"))), "/"), "monthly": F.array_join(dates.date_segments(dates.added_at(F.col("date_added"), F.col("id")), True), "/")}, f"""select id, case when x is null then 'unknown-date' else lpad(year(x)::varchar, 4, '0') end as yearly, case when x is null then 'unknown-date' else lpad(year(x)::varchar, 4, '0') || '/' || lpad(year(x)::varchar, 4, '0') || '-' || lpad(month(x)::varchar, 2, '0') end as monthly from (select id, {_AT} as x from bookmark)""")
scalar("dt4_year_bucket", lambda: {"out": dates.year_bucket(F.col("date_added"), 2025)}, f"select id, case when y is null then 'unknown' when y >= 2025 then 'this year' when y = 2024 then 'last year' else y::varchar end as out from (select id, year(epoch_ms({_MS('nullif(date_added, 0)')})) as y from bookmark)")
scalar("dt5_unix_seconds", lambda: {"out": dates.unix_seconds(F.col("date_added"), 1_700_000_000_000)}, _c("floor((case when coalesce(date_added, 0) = 0 then 1700000000000 else date_added end) / 1000)::bigint"))
scalar("mth1_confidence", lambda: {"out": dates.confidence((F.col("id") % 17).cast("double"))}, _c("round(least(0.97, 0.45 + 0.05 * (id % 17)::double), 2)::double"))
scalar("mth3_clamp", lambda: {"out": dates.clamp01(F.col("date_added") / 1_600_000_000_000)}, _c("least(greatest(coalesce(date_added / 1600000000000, 0.5), 0.0), 1.0)::double"))
scalar("arr1_path_depth", lambda: {"out": F.size(dates.path_array(F.col("path")))}, _c(f"len({_PATH})::int"))
scalar("arr2_under_root", lambda: {"out": dates.under_root(dates.path_array(F.col("path")), ["Bar"])}, _c(f"coalesce({_PATH}[1] = 'Bar', false)"))
scalar("arr3_unfiled", lambda: {"out": F.size(dates.path_array(F.col("path"))) == 0}, _c(f"len({_PATH}) = 0"))
_ANSWER = lambda: F.concat(F.lit("Sure:\n```json\n{'assignments': [{id: \""), F.col("id").cast("string"), F.lit("\", category: 'dev', 'confidence': 0.9,},],}\n```\nDone."))
scalar("jsn1_outer_json", lambda: {"out": text.outer_json(_ANSWER())}, """select id, '{''assignments'': [{id: "' || id || '", category: ''dev'', ''confidence'': 0.9,},],}' as out from bookmark""")
scalar("jsn2_repaired_json", lambda: {"out": F.variant_get(text.parsed_json(_ANSWER()), "$.assignments[0].id", "string")}, _c("id::varchar"))
