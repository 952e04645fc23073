"""Queries of the smaller operators: sources, sinks, sorting, sets, status maps, mutations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklake.functions import dates, text, urls
from linklake.operators import hierarchy, linkcheck, snapshots, tree
from linklake.plans import duck
from linklake.plans.engines import _DOWN, _LINK, _NODES, _PATH
from linklake.runtime import Workspace, table
from linklake.sources import netscape

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"with {_NODES} select id, url from cur where {_LINK}")
def src15_extract_links(spark, d):
    return hierarchy.current_nodes(table(spark, d, "nodes")).where(~tree.is_folder()).select("id", "url")


@query("""select id, 'linklake.backup' as s, 2 as v, title from bookmark""")
def snk1_json_envelope(spark, d):
    j = netscape.envelope(F.struct("id", "title"), "2025-01-01T00:00:00Z")
    b = table(spark, d, "bookmark").select(j.alias("j"))
    get = lambda p: F.get_json_object("j", p)
    return b.select(get("$.data.id").cast("bigint").alias("id"), get("$.schema").alias("s"), get("$.version").cast("int").alias("v"), get("$.data.title").alias("title"))


_NAME = duck.trimmed("""regexp_replace(coalesce(nullif({}, ''), 'export'), '[\\/:*?"<>|]+', '-', 'g')""".format(duck.trimmed("title")))


@query(rf"""select id, case when ends_with(lower(n), '.json') then n else regexp_replace(n, '(?i)\.(json|html)$', '') || '.json' end as name from (select id, {_NAME} as n from bookmark)""")
def snk7_export_name(spark, d):
    return table(spark, d, "bookmark").select("id", netscape.export_name(F.col("title"), ".json", "export").alias("name"))


@query("select snapshot_id, coalesce(action, 'snapshot') || ' (' || n || ')' as described from (select distinct snapshot_id, action from snapshots) join (select snapshot_id, count(distinct id) as n from node_snapshots group by 1) using (snapshot_id)")
def str22_describe_action(spark, d):
    n = table(spark, d, "node_snapshots").groupBy("snapshot_id").agg(F.count_distinct("id").alias("n"))
    s = table(spark, d, "snapshots").select("snapshot_id", "action").distinct()
    return s.join(n, "snapshot_id").select("snapshot_id", F.concat(F.coalesce("action", F.lit("snapshot")), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("described"))


_LNK1 = "case when s between 200 and 299 then 'ok' when s between 300 and 399 then 'redirect' when s in (401, 403, 429) then 'blocked' when s between 500 and 599 then 'server_error' else 'broken' end"


@query(f"select id, {_LNK1} as status from (select id, (100 + id % 600)::int as s from bookmark)")
def lnk1_status_map(spark, d):
    return table(spark, d, "bookmark").select("id", linkcheck.state_of((F.col("id") % 600 + 100).cast("int")).alias("status"))


@query("select id, case when h in (-1, 400, 403, 405, 406, 501) then g else h end as settled from (select id, (case id % 4 when 0 then -1 when 1 then 405 when 2 then 200 else 404 end)::int as h, (200 + id % 200)::int as g from bookmark)")
def lnk3_head_then_get(spark, d):
    h = F.when(F.col("id") % 4 == 0, -1).when(F.col("id") % 4 == 1, 405).when(F.col("id") % 4 == 2, 200).otherwise(404)
    return table(spark, d, "bookmark").select("id", linkcheck.settled_status(h, (F.col("id") % 200 + 200).cast("int"), F.lit(None).cast("int"), 0).alias("settled"))


@query(f"select count(*) filter (ok) as valid, count(*) filter (not ok) as invalid from (select coalesce({duck.is_web('a')} and {duck.host_of('a')} <> '', false) as ok from (select {duck.absolute('url')} as a from bookmark))")
def agg25_validation_counts(spark, d):
    ok = urls.is_valid(F.col("url"))
    return table(spark, d, "bookmark").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query(f"select distinct name from (select unnest({_PATH}) as name from bookmark)")
def set1_path_names(spark, d):
    return table(spark, d, "bookmark").select(F.explode(dates.path_array(F.col("path"))).alias("name")).distinct()


@query("select id::varchar as id, url, 'bookmark' as kind from bookmark union all select id, url, 'node' from nodes where url is not null")
def set2_union(spark, d):
    b = table(spark, d, "bookmark").select(F.col("id").cast("string").alias("id"), "url", F.lit("bookmark").alias("kind"))
    return b.unionByName(table(spark, d, "nodes").where("url is not null").select("id", "url", F.lit("node").alias("kind")))


@query(f"with recursive {_NODES}, {_DOWN}, r as (select min(id) as id from tree where parent is null), below as (select t.id from tree t join r on t.parent = r.id union all select t.id from tree t join below b on t.parent = b.id) select id from cur where id not in (select id from below)")
def dml4_clear_folder(spark, d):
    n = Workspace(spark, "clear").put(table(spark, d, "nodes"))
    cur = hierarchy.current_nodes(n, ["parent_id", "idx", "title", "url"])
    root = hierarchy.resolve(hierarchy.current_nodes(n, ["parent_id"])).where("depth = 0").agg(F.min("id")).first()[0]
    return tree.delete_subtree(n, root, keep_root=True).join(cur.select("id"), "id", "left_semi").select("id").distinct()


@query(f"with {_NODES} select 's1' as snapshot_id, id, parent_id, title from cur")
def dml12_take_snapshot(spark, d):
    return snapshots.take(hierarchy.current_nodes(table(spark, d, "nodes")), "s1", "2025-01-01 00:00:00", "manual").select("snapshot_id", "id", "parent_id", "title")
