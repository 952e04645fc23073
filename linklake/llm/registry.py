"""Queries of the training-data operators and the SQL that restates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklake.llm import components, format_copies, leakage, near_copies, packing, residue, survivorship
from linklake.plans import duck
from linklake.runtime import Workspace, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.survivor_ids(table(spark, d, "dup_members"), table(spark, d, "bookmark"), table(spark, d, "import_source"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    s = survivorship.survivors(table(spark, d, "dup_members"), table(spark, d, "bookmark"), table(spark, d, "import_source"))
    return s.select("group_id", "path", "date_added", "url")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.copy_links(table(spark, d, "bookmark"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return format_copies.collapse(table(spark, d, "bookmark")).select("id", "n_copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.groups(table(spark, d, "match_pairs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.near_pairs(table(spark, d, "bookmark"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, d, "documents")), 2048)


def p8_valid(spark: SparkSession, d: str) -> DataFrame:
    """One row that says what a packing must keep: overfull sequences, splits of texts that fit, texts whose pieces leave
    gaps or overlap, texts placed, and whether 95 % of the room is in use."""
    capacity = 2048
    packed = Workspace(spark, "valid").put(packing.pack(table(spark, d, "documents"), capacity))
    n = packed.groupBy("sequence").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("overfull"), (F.sum("n") >= 0.95 * capacity * F.count("*")).alias("well_filled"))
    of = packed.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("m"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.min("start").alias("first"))
    docs = of.agg(F.count_if((F.col("k") > 1) & (F.col("m") <= capacity)).alias("needless_splits"), F.count_if((F.col("m") != F.col("end")) | (F.col("first") != 0)).alias("gaps"), F.count("*").alias("n_documents"))
    return n.crossJoin(docs)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    leaks = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return leaks.where("kind = 'copy'").select("item_id", "doc_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked document with the longest run, paraphrases included."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents")).select("doc_id", "n_chars")


QUERIES = {q.__name__: q for q in (p1_found, p1_records, p2_found, p2_collapsed, p5_found, p6_found, p8_pack, p8_fill, p8_valid, p9_found, p9_report, p10_found, p10_kept)}

_EDGE = r"[\s\x{00}-\x{20}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_CUT = lambda c: f"regexp_replace({c}, '^{_EDGE}|{_EDGE}$', '', 'g')"
_FOLD = lambda s: rf"regexp_replace(replace(lower({s}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_P1 = rf"""m as (select distinct group_id, id from dup_members), t as (select lower(trim(source)) as s, min(trust) as trust from import_source group by 1),
  r as (select m.group_id, b.*, len(list_filter(string_split(path, '/'), lambda p: {_CUT('p')} <> '')) as depth,
               case when date_added > 0 and date_added < 4000000000000000 and date_added * 1000 <= epoch_us(loaded_at) then date_added end as ok,
               case when regexp_matches({_CUT('url')}, '^(?i:https?)://(?:[^/?#@\s]*@)?[^/?#:@\s.]+(\.[^/?#:@\s.]+)+\.?(?::[0-9]*)?(?:[/?#]|$)') then coalesce(t.trust, 1000000) end as place
        from m join bookmark b using (id) left join t on t.s = lower({_CUT('b.source')})),
  p as (select * from r qualify row_number() over (partition by group_id order by coalesce(depth, 0) desc, id) = 1),
  a as (select * from r qualify row_number() over (partition by group_id order by ok desc nulls last, id) = 1),
  u as (select * from r qualify row_number() over (partition by group_id order by place nulls last, id) = 1)"""
_P2 = rf"""k as (select id, {_FOLD("coalesce(title, '')")} as t, coalesce(url, '') as u from bookmark),
  q as (select id, t, u, regexp_extract(u, '(?s)^([^?#]*)', 1) as head, regexp_extract(u, '(?s)^[^?#]*\?([^#]*)', 1) as query, regexp_extract(u, '(?s)(#.*)$', 1) as frag from k),
  keyed as (select id, t, {_FOLD("url_decode(head)")} || array_to_string(list_sort(list_transform(regexp_split_to_array(query, '[&;]'), lambda f: {_FOLD("url_decode(f)")})), '') || {_FOLD("url_decode(frag)")} as k from q),
  sets as (select t, k, min(id) as first_id, count(*) as n from keyed group by t, k)"""
_P6 = f"""{_P2}, nrm as ({duck.normalize('bookmark', 'url', 'norm', 'id, title')}),
  base as materialized (select n.id, {duck.tokens('n.title')} as tk, {duck.squeezed('n.title')} as s, {duck.squeezed('n.norm')} as w, d.t || '|' || d.k as copy from nrm n join keyed d using (id)),
  posts as materialized (select id, len(tk) as m, unnest(tk) as token, copy from base),
  near as materialized (select p.id as id_a, q.id as id_b, count(*)::double / (any_value(p.m) + any_value(q.m) - count(*)) as j
    from posts p join posts q on p.token = q.token and p.id < q.id and p.copy <> q.copy group by 1, 2 having count(*) * 5 >= 2 * (any_value(p.m) + any_value(q.m) - count(*))),
  feats as materialized (select *, {duck.grams('s')} as gs, {duck.grams('w')} as gw from base where id in (select id_a from near union select id_b from near))"""
# every run of n terms as text; items are few, so their runs are looked up
_RUNS = lambda t, n: f"select {{0}} as k, unnest(list_transform(range(1, greatest(len({t}) - {n - 2}, 1)), lambda i: array_to_string(list_slice({t}, i, i + {n - 1}), ' '))) as r from {{1}}"
_TERMS = lambda k, source: rf"select {k}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as w, regexp_extract_all(text, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{f900}}-\x{{faff}}\x{{20000}}-\x{{323af}}]') as h from {source} where text is not null"
_P9 = f"""d as ({_TERMS('doc_id', 'documents')}), i as ({_TERMS('item_id', 'benchmark')}),
  dw as ({_RUNS('w', 15).format('doc_id', 'd')}), iw as ({_RUNS('w', 15).format('item_id', 'i')}), dh as ({_RUNS('h', 24).format('doc_id', 'd')}), ih as ({_RUNS('h', 24).format('item_id', 'i')})"""

ORACLES = {
    "p1_found": f"with {_P1} select group_id, 'path' as field_name, id from p union all select group_id, 'date_added', id from a union all select group_id, 'url', id from u",
    "p1_records": f"with {_P1} select p.group_id, p.path, a.date_added, u.url from p join a using (group_id) join u using (group_id)",
    "p2_found": f"with {_P2} select first_id, id as copy_id from keyed join sets using (t, k) where id <> first_id",
    "p2_collapsed": f"with {_P2} select first_id as id, n as n_copies from sets",
    "p6_found": f"""with {_P6} select id_a, id_b from near join feats x on x.id = id_a join feats y on y.id = id_b
        where 0.5 * j + 0.2 * {duck.dice_sets('x.s', 'y.s', 'x.gs', 'y.gs')} + 0.3 * {duck.dice_sets('x.w', 'y.w', 'x.gw', 'y.gw')} >= 0.7""",
    "p8_valid": "select 0 as overfull, true as well_filled, 0 as needless_splits, 0 as gaps, count(distinct doc_id) as n_documents from documents where text <> ''",
    "p9_found": f"with {_P9} select iw.k as item_id, dw.k as doc_id from dw join iw using (r) union select ih.k, dh.k from dh join ih using (r)",
    "p5_found": """with recursive e as (select distinct id_a as u, id_b as v from match_pairs where id_a <> id_b union select distinct id_b, id_a from match_pairs where id_a <> id_b),
        w as (select u as id, u as up from e union select w.id, e.v from w join e on e.u = w.up)
        select min(up) as first_id, id from w group by id""",
}
