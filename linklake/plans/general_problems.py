"""Queries of the general data problems (3, 4 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linklake.functions import urls
from linklake.operators import hierarchy, hot_keys, snapshot_diff
from linklake.plans import duck
from linklake.runtime import table


def _site() -> Column:
    """Host of a full http(s) address; null otherwise."""
    return F.when(urls.is_web(urls.trimmed(F.col("url"))), urls.let(urls.hostname(F.col("url")), lambda h: F.when(h != "", h)))


def p3_sites(spark: SparkSession, d: str) -> DataFrame:
    """Rows, pages (distinct canonical addresses) and last date_added of every site."""
    r = hot_keys.per_key(table(spark, d, "bookmark"), _site(), urls.normalize(F.col("url")), F.col("date_added"))
    return r.select(F.col("key").alias("site"), "n_rows", F.col("n_items").alias("n_pages"), F.col("last").alias("last_added"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Sites with at least 2 % of all rows; only rows are counted, so a site is one entry of a task from the start."""
    b, none = table(spark, d, "bookmark"), F.lit(None)
    counts = hot_keys.per_key(b, _site(), none.cast("string"), none.cast("bigint"))
    return counts.where(F.col("n_rows") * 50 >= b.count()).select(F.col("key").alias("site"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.replay(table(spark, d, "snapshots"), table(spark, d, "node_snapshots"))


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """The changes with the old and new values of every node."""
    r = snapshot_diff.replay(table(spark, d, "snapshots"), table(spark, d, "node_snapshots"), values=True)
    return r.select("snapshot_id", "id", "change_kind", F.col("old.title").alias("old_title"), F.col("new.title").alias("new_title"), F.col("old.url").alias("old_url"), F.col("new.url").alias("new_url"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(hierarchy.current_nodes(table(spark, d, "nodes"), ["parent_id"])).select("id", "root_id", "depth")


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.full_hierarchy(table(spark, d, "nodes"))
    return h.select("id", "root_id", "depth", F.array_join("path", " / ").alias("path"), "order_key")


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "nodes")).select("ancestor_id", "id", "distance")


QUERIES = {q.__name__: q for q in (p3_sites, p3_found, p4_found, p4_values, p7_found, p7_paths, p7_descendants)}

_SITE = f"select *, case when {duck.is_web(duck.trimmed('url'))} then nullif({duck.hostname('url')}, '') end as site from bookmark"
_NODES = """cur as (select * from (select *, row_number() over (partition by id order by loaded_at desc nulls last, parent_id desc nulls last, idx desc nulls last, title desc nulls last, url desc nulls last) as rn
                     from nodes where trim(id) <> '') where rn = 1),
  tree as (select c.id, case when p.id is null then null else c.parent_id end as parent, c.idx, c.title from cur c left join cur p on trim(c.parent_id) <> '' and p.id = c.parent_id)"""
_SIBLING = "coalesce(lpad(case when t.idx >= 0 then t.idx end::varchar, 10, '0'), '~~~~~~~~~~') || ':' || t.id"
_DOWN = f"""down as (select t.id, t.id as root_id, 0 as depth, coalesce(trim(t.title), '') as path, {_SIBLING} as order_key from tree t where parent is null
           union all select t.id, d.root_id, d.depth + 1, d.path || ' / ' || coalesce(trim(t.title), ''), d.order_key || '/' || {_SIBLING} from tree t join down d on t.parent = d.id)"""
_STUCK = """stuck as (select t.id, t.parent from tree t anti join down d on d.id = t.id),
  walk as (select id, parent as up from stuck union select w.id, s.parent from walk w join stuck s on s.id = w.up),
  ring as (select id from walk where id = up),
  low as (select w.id, min(w.up) as root_id from walk w join ring r on r.id = w.up group by w.id)"""
_P4 = """with s as (select distinct snapshot_id, library_id, created_at from snapshots),
        c as (select *, lead(snapshot_id) over w as prober, row_number() over w = 1 as is_first from s window w as (partition by library_id order by created_at, snapshot_id)),
        r as (select * from (select *, row_number() over (partition by snapshot_id, id order by loaded_at desc nulls last) as rn from node_snapshots) where rn = 1),
        new as (select r.* from r join c using (snapshot_id) where not is_first),
        old as (select c.prober as snapshot_id, r.id, r.parent_id, r.title, r.url from r join c using (snapshot_id) where prober is not null),
        changes as (select coalesce(n.snapshot_id, o.snapshot_id) as snapshot_id, coalesce(n.id, o.id) as id,
               case when o.id is null then 'added' when n.id is null then 'removed' else 'changed' end as change_kind,
               o.title as old_title, n.title as new_title, o.url as old_url, n.url as new_url
        from new n full join old o on n.snapshot_id = o.snapshot_id and n.id = o.id
        where o.id is null or n.id is null or n.parent_id is distinct from o.parent_id or n.title is distinct from o.title or n.url is distinct from o.url)"""

ORACLES = {
    "p3_sites": f"""with s as ({_SITE}), n as ({duck.normalize('s', 'url', 'norm', 'site, date_added')})
        select site, count(*) as n_rows, count(distinct norm) as n_pages, max(date_added) as last_added from n where site is not null group by site""",
    "p3_found": f"with s as ({_SITE}) select site from s where site is not null group by site having count(*) * 50 >= (select count(*) from bookmark)",
    "p4_found": f"{_P4} select snapshot_id, id, change_kind from changes",
    "p4_values": f"{_P4} select snapshot_id, id, change_kind, old_title, new_title, old_url, new_url from changes",
    "p7_found": f"with recursive {_NODES}, {_DOWN}, {_STUCK} select id, root_id, depth from down union all select id, root_id, -1 from low",
    "p7_paths": f"with recursive {_NODES}, {_DOWN}, {_STUCK} select id, root_id, depth, path, order_key from down union all select id, root_id, -1, null, null from low",
    "p7_descendants": f"""with recursive {_NODES}, {_DOWN}, {_STUCK}, off as (select * from tree where parent is not null and id not in (select id from ring)),
        up as (select id, parent as ancestor_id, 1 as distance from off union all select u.id, t.parent, u.distance + 1 from up u join off t on t.id = u.ancestor_id)
        select ancestor_id, id, distance from up""",
}
