"""Queries of portable forms, further classifiers, running plans, snapshot upkeep and the label pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklake.functions import dates, text, urls
from linklake.operators import archive, classify, hierarchy, labels, linkcheck, planner, search, snapshots, tree
from linklake.plans import duck
from linklake.plans.engines import _CHECK, _CLASS, _DOWN, _LAST, _LINK, _NB, _NODES, _PATH, _RESP, _classified, _responses
from linklake.runtime import Workspace, table
from linklake.sources import netscape, portable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _current(spark, d, *more):
    return hierarchy.current_nodes(table(spark, d, "nodes"), ["parent_id", "idx", "title", "url", *more])


# ---- portable forms
_POS = """pos as (select *, case when parent is null then 0 else row_number() over (partition by parent order by lpad(case when idx >= 0 then idx end::varchar, 10, '0') nulls last, id) - 1 end as place from tree)"""
_TREES = f"""with recursive {_NODES}, {_POS}, walk as (select id, id as root_id, 0 as depth, [0] as places from pos where parent is null
  union all select p.id, w.root_id, w.depth + 1, list_append(w.places, p.place::int) from pos p join walk w on p.parent = w.id)"""


@query(f"{_TREES} select w.id, t.parent as parent_id, w.places[-1] as idx, c.title, c.url, array_to_string(w.places, '.') as order_key from walk w join tree t using (id) join cur c using (id)")
def src7_json_tree(spark, d):
    """Every tree written as nested JSON and read again, with its place and preorder key."""
    trees = portable.gathered(portable.json_lines(portable.placed(_current(spark, d))), "")
    r = tree.from_json_tree(Workspace(spark, "trees").put(trees), "content")
    return r.select("id", "parent_id", "idx", "title", "url", F.array_join(F.transform("order_key", lambda i: i.cast("string")), ".").alias("order_key"))


_ESC = lambda c: f"""replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""
_UNIX = lambda c: f"floor((case when coalesce({c}, 0) = 0 then 1700000000000 else {c} end) / 1000)::bigint"
_PAD = "repeat('    ', depth + 1)"
_ANCHOR = lambda added: f"""{_PAD} || '<DT><A HREF="' || {_ESC('c.url')} || '" ADD_DATE="' || {added} || '">' || {_ESC('c.title')} || '</A>'"""
_IS_URL = "coalesce(c.url <> '', false)"


@query(f"""{_TREES} select root_id, case when {_IS_URL} then {_ANCHOR(_UNIX('c.date_added'))}
  else {_PAD} || '<DT><H3 ADD_DATE="' || {_UNIX('c.date_added')} || '" LAST_MODIFIED="' || {_UNIX('c.date_group_modified')} || '">' || {_ESC('c.title')} || '</H3>' || chr(10) || {_PAD} || '<DL><p>' end as line from walk join cur c using (id)
  union all select root_id, {_PAD} || '</DL><p>' from walk join cur c using (id) where not {_IS_URL}""")
def snk3_tree_html(spark, d):
    lines = portable.html_lines(portable.placed(_current(spark, d, "date_added", "date_group_modified")), 1_700_000_000_000)
    return lines.select("root_id", "line")


_ONE = f"one as (select * from {_LAST} where snapshot_id = (select max(snapshot_id) from node_snapshots))"


@query("select id, parent_id, idx, title, url from (select *, row_number() over (partition by id order by loaded_at desc nulls last, parent_id desc nulls last, idx desc nulls last, title desc nulls last, url desc nulls last) as rn from node_snapshots where snapshot_id = (select max(snapshot_id) from node_snapshots)) where rn = 1")
def snk4_snapshot_json(spark, d):
    """A snapshot as JSON lines and back."""
    rows = table(spark, d, "node_snapshots")
    s = snapshots.get(rows, rows.agg(F.max("snapshot_id")).first()[0])
    back = s.select(F.from_json(F.to_json(F.struct("*"), {"pretty": "true"}), "id string, parent_id string, idx int, title string, url string").alias("r"))
    return back.select("r.*")


@query(f"""with recursive {_ONE}, known as (select o.*, case when p.id is null then null else o.parent_id end as parent from one o left join one p on trim(o.parent_id) <> '' and p.id = o.parent_id),
  walk as (select id, 0 as depth from known where parent is null union all select k.id, w.depth + 1 from known k join walk w on k.parent = w.id)
  select case when {_IS_URL} then {_PAD} || '<DT><A HREF="' || {_ESC('c.url')} || '" ADD_DATE="">' || {_ESC('c.title')} || '</A>' else {_PAD} || '<DT><H3 ADD_DATE="">' || {_ESC('c.title')} || '</H3>' || chr(10) || {_PAD} || '<DL><p>' end as line from walk join one c using (id)
  union all select {_PAD} || '</DL><p>' from walk join one c using (id) where not {_IS_URL}""")
def snk5_snapshot_html(spark, d):
    rows = table(spark, d, "node_snapshots")
    s = snapshots.get(rows, rows.agg(F.max("snapshot_id")).first()[0]).withColumns({"idx": F.coalesce("idx", F.lit(0)), "date_added": F.lit(None).cast("bigint")})
    return portable.html_lines(portable.placed(s)).select("line")


@query(f"""select title, url, path, kind from (select coalesce(title, '') as title, url, array_to_string({_PATH}, '/') as path, 'bookmark' as kind from bookmark where coalesce(url <> '', false)
  union all select coalesce(title, ''), url, 'Exported Tabs', 'tab' from nodes where coalesce(url <> '', false))""")
def snk6_export_rows(spark, d):
    """Rows of a joint export: bookmarks, and open tabs as a folder of their own."""
    p = F.array_join(dates.path_array(F.col("path")), "/")
    b = portable.with_address(table(spark, d, "bookmark")).select(F.coalesce("title", F.lit("")).alias("title"), "url", p.alias("path"), F.lit("bookmark").alias("kind"))
    return b.unionByName(portable.with_address(table(spark, d, "nodes")).select(F.coalesce("title", F.lit("")).alias("title"), "url", F.lit("Exported Tabs").alias("path"), F.lit("tab").alias("kind")))


_OK = f"(select * from (select *, {duck.absolute('url')} as a from bookmark) where {duck.is_web('a')} and {duck.host_of('a')} <> '')"
_ONE_SPACE = r"trim(regexp_replace({}, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


@query(f"select library_id, {_ONE_SPACE.format("coalesce(title, '')")} as title, {duck.trimmed('url')} as url, array_to_string(list_transform({_PATH}, lambda p: {_ONE_SPACE.format('p')}), '/') as path, (date_added / 1000)::double as add_date from {_OK} where library_id is not null")
def snk2_netscape_round_trip(spark, d):
    """All bookmarks as one bookmark file, with whole paths and dates; each library's part of it is read again."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"[\s\x0B\x1C-\x1F\u0085   -     　]+", " "))
    b = table(spark, d, "bookmark").where(urls.is_valid(F.col("url")) & F.col("library_id").isNotNull())
    path = F.concat(F.array("library_id"), F.transform(dates.path_array(F.col("path")), flat))
    recs = b.select(F.col("id").alias("ord"), flat(F.coalesce("title", F.lit(""))).alias("title"), urls.trimmed(F.col("url")).alias("url"), path.alias("path"), (F.col("date_added") / 1000).alias("add_date"), F.lit(None).cast("string").alias("icon"))
    lines = netscape.lines(Workspace(spark, "file").put(recs)).select(F.substring("key", 1, 13).alias("root_id"), "key", "line")
    r = netscape.records(portable.gathered(lines), "root_id", "content")
    return r.select(F.col("path")[0].alias("library_id"), "title", "url", F.array_join(F.slice("path", 2, 100), "/").alias("path"), "add_date")


@query("select id, date_added is not null as ok from bookmark")
def src11_parse_json(spark, d):
    """Objects with a date; where there is none the text breaks off."""
    j = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.coalesce(F.concat(F.lit(', "at": '), F.col("date_added").cast("string"), F.lit("}")), F.lit("")))
    return table(spark, d, "bookmark").select("id", portable.parses(j).alias("ok"))


@query(f"select doc_id, case when starts_with({duck.trimmed('text')}, '<') then 'html' else 'json' end as format from documents where text is not null union all select doc_id, 'json' from documents where text is null")
def src12_sniff_format(spark, d):
    return table(spark, d, "documents").select("doc_id", portable.sniffed(F.col("text")).alias("format"))


@query(f"with {_NODES} select parent_id, id from cur where parent_id is not null")
def src13_import_nodes(spark, d):
    """The children of every folder as one import text: a single folder that holds them, which is unwrapped."""
    kids = _current(spark, d).where("parent_id is not null").groupBy("parent_id").agg(F.collect_list(F.struct("id", "title")).alias("children"))
    j = kids.select("parent_id", F.to_json(F.array(F.struct(F.col("parent_id").alias("id"), "children"))).alias("j"))
    return j.select("parent_id", F.explode(portable.import_nodes(F.col("j"))).alias("n")).select("parent_id", F.try_variant_get("n", "$.id", "string").alias("id"))


@query("select id, url, title from bookmark where coalesce(url <> '', false)")
def src14_tab_lists(spark, d):
    """Each bookmark as a tab in one of the three forms, by its source; tabs without an address are dropped."""
    tab = F.array(F.struct("url", "title"))
    b = table(spark, d, "bookmark")
    form = F.when(F.col("source").isNull(), F.to_json(tab)).when(F.length("source") % 2 == 0, F.to_json(F.struct(tab.alias("tabs")))).otherwise(F.to_json(F.struct(F.array(F.struct(tab.alias("tabs"))).alias("windows"))))
    t = b.select("id", F.explode(portable.import_tabs(form)).alias("t"))
    get = lambda p: F.try_variant_get("t", p, "string")
    return portable.with_address(t.select("id", get("$.url").alias("url"), get("$.title").alias("title")))


@query("select id, strftime(loaded_at, '%Y-%m-%d_%H%M%S') as stamp from bookmark")
def dt6_stamps(spark, d):
    return table(spark, d, "bookmark").select("id", portable.stamp(F.col("loaded_at")).alias("stamp"))


@query("select library_id, coalesce(min(source), 'all') as scope, '5' as keep from bookmark group by library_id")
def src18_settings(spark, d):
    """Each library's saved settings over the defaults."""
    saved = table(spark, d, "bookmark").groupBy("library_id").agg(F.min("source").alias("scope")).select("library_id", F.to_json(F.struct(F.struct("scope").alias("view"))).alias("saved"))
    s = portable.settings(F.col("saved"), {"view": {"scope": "all"}, "backup": {"keep": 5}})
    return saved.select("library_id", s["view.scope"].alias("scope"), s["backup.keep"].alias("keep"))


# ---- trees
@query(f"with {_NODES} select id, parent_id, title from cur where id = (select min(id) from nodes)")
def src3_node(spark, d):
    n = table(spark, d, "nodes")
    return tree.node(n, n.agg(F.min("id")).first()[0]).select("id", "parent_id", "title")


@query(f"""with recursive {_NODES}, {_DOWN}, links as (select c.id from cur c where {_LINK}), up as (select t.id, t.parent from tree t join links using (id) union select p.id, p.parent from up u join tree p on p.id = u.parent),
  twins as (select id from (select id, count(*) over (partition by parent_id, lower(title)) as n from cur where not {_LINK} and trim(title) <> '' and trim(parent_id) <> '') where n > 1)
  select d.id, d.depth from down d join cur c using (id) where not {_LINK} and d.id not in (select id from up) and d.id not in (select id from twins)""")
def srt3_empty_folders(spark, d):
    """Empty folders, deepest first, without those that a report of duplicate folders shows already (JN19)."""
    n = Workspace(spark, "nodes").put(table(spark, d, "nodes"))
    f = hierarchy.current_nodes(n).where(tree.is_folder())
    twins = f.withColumn("name", F.lower("title")).join(tree.duplicate_folders(n).select("parent_id", "name"), ["parent_id", "name"])
    return tree.deepest_first(tree.without(tree.empty_folders(n), twins))


@query(f"with {_NODES} select id, case when parent_id is null and not {_LINK} and title = 'Old trash' then 'Trash' else title end as title from cur where false union all select id, title from cur union all select 'made', 'Trash'")
def dml2_trash_folder(spark, d):
    cur = _current(spark, d)
    n = tree.trash(cur.select("id", "parent_id", "title", "url"), cur.agg(F.min("id")).first()[0], "Trash", ["Old trash"])
    return n.select(F.when(F.col("title") == "Trash", "made").otherwise(F.col("id")).alias("id"), "title")


_MOVES = f"mv as (select id, parent_id as from_parent, upper(left(trim(title), 1)) as folder from cur where {_LINK} and trim(title) <> ''), root as (select min(id) as root from cur)"


@query(f"""with {_NODES}, {_MOVES}, todo as (select * from mv), kept as (select c.id, case when t.id is null then c.parent_id else t.folder end as place from cur c left join todo t on t.id = c.id),
  gone as (select distinct from_parent as id from todo where from_parent is not null except select place from kept), out as (select id from gone join cur using (id) where coalesce(parent_id, '') <> '0' and id not in ('0', '1', '2', '3'))
  select id, place from kept where id not in (select id from out) union all select null, folder from (select distinct folder from todo)""")
def dml7_run_archive(spark, d):
    """Every link with a title goes into a folder of its first letter; emptied folders go."""
    cur = Workspace(spark, "cur").put(_current(spark, d))
    moves = cur.where(~tree.is_folder() & (F.trim("title") != "")).select("id", F.upper(F.left(F.trim("title"), F.lit(1))).alias("folder"))
    new, _, _ = archive.run(cur, moves, "archive-root")
    made = new.where("parent_id = 'archive-root'").select(F.col("id").alias("parent_id"), F.col("title").alias("name"))
    j = new.where("coalesce(parent_id, '') <> 'archive-root'").join(made, "parent_id", "left").select("id", F.coalesce("name", "parent_id").alias("place"))
    return j.union(made.select(F.lit(None).cast("string"), "name"))


@query(f"select id, case when contains(lower(coalesce(title, '') || ' ' || coalesce(url, '')), 'archive') then 'Old' else coalesce({_PATH}[1], 'unfiled') end as folder from bookmark")
def dml8_bulk_target(spark, d):
    b = table(spark, d, "bookmark")
    moves = b.select("id", F.coalesce(F.try_element_at(dates.path_array(F.col("path")), F.lit(1)), F.lit("unfiled")).alias("folder"))
    return archive.retarget(moves, search.any_keyword(b, "archive"), "Old")


# ---- snapshots
@query("select snapshot_id, library_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, action, coalesce(total, 0) as total from (select distinct snapshot_id, library_id, created_at, action from snapshots) left join (select snapshot_id, count(distinct id) as total from node_snapshots group by 1) using (snapshot_id)")
def dml13_list_snapshots(spark, d):
    r = snapshots.listed(table(spark, d, "snapshots"), table(spark, d, "node_snapshots"))
    return r.select("snapshot_id", "library_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "action", "total")


@query("select snapshot_id, count(*) as n from node_snapshots where snapshot_id <> (select max(snapshot_id) from node_snapshots) group by 1")
def dml13_delete_snapshot(spark, d):
    rows = table(spark, d, "node_snapshots")
    return snapshots.deleted(rows, [rows.agg(F.max("snapshot_id")).first()[0]]).groupBy("snapshot_id").agg(F.count("*").alias("n"))


@query(f"with {_ONE}, b as (select min(id) as b from one) select count(*) filter (id <> b) as created, count(*) as total from one, b")
def dml14_restore_counts(spark, d):
    rows = table(spark, d, "node_snapshots")
    last = rows.agg(F.max("snapshot_id")).first()[0]
    root = snapshots.get(rows, last).agg(F.min("id")).first()[0]
    return snapshots.restore_tree(rows, last, [root])[1]


# ---- classifiers and groups
_HOST = f"(select *, case when a is null then '' else {duck.host_of('a')} end as h from (select *, {duck.absolute('url')} as a from bookmark))"
_TYPE = "case " + " ".join(f"when regexp_matches(b, '{p}') then '{label}'" for label, p in archive.TYPE_PATTERNS) + rf" when regexp_matches(lower(coalesce(url, '')), '{archive.FILE_PATTERN}') then '{archive.FILE_LABEL}' else '{archive.OTHER_LABEL}' end"


@query(f"select id, {_TYPE} as label from (select id, url, {duck.base_domain_of('h')} as b from {_HOST})")
def eng9_type_label(spark, d):
    return table(spark, d, "bookmark").select("id", archive.type_label(F.col("url")).alias("label"))


_ENDINGS = {"text": ["pdf", "txt", "md"], "code": ["py", "js", "html"]}
_RULE_SET = [("culture", ["wikilore.example", "oakpost.example"], ["museum", "library", "archive"], ["museum", "concert"]), ("town", ["quillshelf.example"], ["harbour", "school", "garden"], [])]


def _rule_sql(endings=_ENDINGS, rules=_RULE_SET) -> str:
    hits = lambda ws, hay: f"least({' + '.join(f'contains({hay}, {chr(39)}{w}{chr(39)})::int' for w in ws)}, 5)"
    score = [f"(case when {' or '.join(f'host = {chr(39)}{h}{chr(39)} or ends_with(host, {chr(39)}.{h}{chr(39)})' for h in hosts)} then 100 else 0 end + 10 * {hits(t or w, 'name')} + 5 * {hits(w, 'low')} + 2 * {hits(w, 'pathname')})" for _, hosts, w, t in rules]
    over = [f"(case when {x} > 15 then {x} else 0 end)" for x in score]
    best = f"greatest({', '.join(over)})"
    pick = " ".join(f"when {x} = {best} and {x} > 0 then '{rules[i][0]}'" for i, x in enumerate(over))
    ending = " ".join(f"when ext in ({duck.strings(v)}) then '{k}'" for k, v in endings.items())
    return f"""select id, url, case {ending} {pick} else 'other' end as label from (select *, regexp_extract(pathname, '\\.([a-z0-9]{{1,8}})$', 1) as ext from (select id, url, lower(coalesce(title, '')) as name, lower(coalesce(url, '')) as low,
      regexp_replace(h, '^www\\.', '') as host, lower(coalesce(regexp_extract(url, '^(?i:https?)://[^/?#]*([^?#]*)', 1), '')) as pathname from {_HOST}))"""


@query(f"select id, label from ({_rule_sql()})")
def eng8_rule_class(spark, d):
    return table(spark, d, "bookmark").select("id", archive.rule_class(F.col("title"), F.col("url"), _ENDINGS, _RULE_SET).alias("label"))


@query(f"with {_CLASS} select c.id, case when c.category = 'other' then {_TYPE.replace('(b,', '(t.b,').replace('coalesce(url', 'coalesce(t.url')} else upper(c.category) end as label from cls c join (select id, url, {duck.base_domain_of('host')} as b from src join (select id, host from r) using (id)) t using (id)")
def eng14_local_class(spark, d):
    rows, c = _classified(spark, d)
    return archive.local_class(c, rows, {k: k.upper() for k in classify.TAXONOMY}, archive.type_label(F.col("url")))


_CUSTOM = [("WWW.quillshelf.example", "docs"), ("oakpost.example", "news"), ("forum.oakpost.example", "social"), ("brackenhub.test", "nowhere"), ("", "ai")]


@query(f"""with {_CLASS}, rules(term, category) as (values ('quillshelf.example', 'docs'), ('oakpost.example', 'news'), ('forum.oakpost.example', 'social')), hosts as (select id, regexp_replace(h, '^www\\.', '') as host from {_HOST}),
  hit as (select id, arg_max(category, length(term)) as category from hosts join rules on host = term or ends_with(host, '.' || term) group by id)
  select id, coalesce(hit.category, 'other') as category, case when hit.category is null then 0.15 else 0.97 end::double as confidence from bookmark left join hit using (id)""")
def jn9_custom_hosts(spark, d):
    b = table(spark, d, "bookmark")
    none = b.select("id", F.lit("other").alias("category"), F.lit(0.15).alias("confidence"))
    rules = spark.createDataFrame(_CUSTOM, "host string, category string")
    return archive.with_custom(none, archive.custom_classes(b, rules, list(classify.TAXONOMY)))


@query(f"""select id, case when b = 'quillshelf.example' or t = 'quillshelf.example' or contains(b, 'quillshelf.example') then 'Quill' when b = '文档' or t = '文档' or contains(b, '文档') then 'Papers' when contains(b, 'oak') then 'Oak' end as folder
  from (select id, b, {_TYPE} as t from (select id, url, {duck.base_domain_of('h')} as b from {_HOST}))""")
def jn16_custom_key(spark, d):
    b = table(spark, d, "bookmark")
    key = archive.custom_key([("quillshelf.example", "Quill"), ("文档", "Papers"), ("oak", "Oak")], F.coalesce(urls.base_domain(F.col("url")), F.lit("")), archive.type_label(F.col("url")))
    return b.select("id", key.alias("folder"))


@query(f"""with {_CLASS}, k as (select id, coalesce(nullif(regexp_replace(case when {duck.absolute('url')} is null then '' else {duck.host('url')} end, '^www\\.', ''), ''), url, '') as host from src), f as (select host, arg_min(category, id) as category from k join cls using (id) group by host)
  select id, category from k join f using (host)""")
def win6_host_classes(spark, d):
    rows, c = _classified(spark, d)
    return archive.host_classes(rows, c)


_BASE = f"(select id, case when h = '' then 'other' else {duck.base_domain_of('h')} end as name from {_HOST})"


@query(f"select name, n, id from (select *, count(*) over (partition by name) as n from {_BASE}) where n >= 3")
def eng13_preview(spark, d):
    key = urls.let(urls.base_domain(F.col("url")), lambda h: F.when(h != "", h))
    return archive.preview(table(spark, d, "bookmark"), key, min_size=3)


_PREFER = ["oakpost.example", "quillshelf.example", "brackenhub.test"]


@query(f"select name, n, id from (select *, count(*) over (partition by name) as n from (select id, case when name in ({duck.strings(_PREFER)}) then name else 'other' end as name from {_BASE})) where name in ('oakpost.example', 'other')")
def jn20_visible_groups(spark, d):
    """Groups by preferred names (JN20), of which one is selected (FLT7)."""
    key = urls.let(urls.base_domain(F.col("url")), lambda h: F.when(h != "", h))
    return archive.visible(archive.preview(table(spark, d, "bookmark"), key, _PREFER), ["oakpost.example"])


@query(f"select distinct array_to_string({_PATH}, '/') as path from bookmark where len({_PATH}) > 0")
def srt2_folder_paths(spark, d):
    """All folders by their joined path."""
    p = dates.path_array(F.col("path"))
    return table(spark, d, "bookmark").where(F.size(p) > 0).select(F.array_join(p, "/").alias("path")).distinct().orderBy("path")


@query(f"select id, case when filed then 'filed' when len(ps) > 0 then 'skipped' when n < 2 then 'small' else 'movable' end as status from (select *, count(*) filter (len(ps) = 0) over (partition by name) as n from (select id, {_PATH} as ps, {_PATH}[1] = 'Bar' as filed, lower(case when h = '' then 'unknown' else {duck.base_domain_of('h')} end) as name from {_HOST}))")
def flt9_only_unfiled(spark, d):
    """A plan that moves unfiled rows only, as is the default."""
    return planner.plan(table(spark, d, "bookmark"), "domain", root=["Bar"]).select("id", "status")


@query("select a.id, (case when a.title is null then 0 else 1 end)::double as same from (select id, case when length(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9一-龥]+', '', 'g')) >= 2 then title end as title from bookmark) a")
def str11_similarity_of_itself(spark, d):
    s = archive.legacy_scores(F.col("title"), F.col("title"), F.col("url"), F.col("url"))
    return table(spark, d, "bookmark").select("id", s["title"].alias("same"))


@query("select source, case when zh = '' then '★ ' || en when zh = en then '★ ' || zh else '★ ' || zh || '（' || en || '）' end as label from (select distinct source, upper(trim(source)) as zh, lower(trim(source)) as en from bookmark where trim(source) <> '')")
def str20_labels(spark, d):
    s = table(spark, d, "bookmark").where("trim(source) <> ''").select("source").distinct()
    return s.select("source", archive.full_label(F.lit("★"), F.upper(F.trim("source")), F.lower(F.trim("source"))).alias("label"))


# ---- link states
_REPORT = " ".join(f"when status = '{k}' then '{b}|{name}'" for k, (b, name) in linkcheck.REPORTED.items())


@query(f"with {_CHECK}, rep as (select id, case {_REPORT} end as r from checked) select id, string_split(r, '|')[1] as bucket, string_split(r, '|')[2] as label from rep where r is not null and string_split(r, '|')[1] in ('status', 'empty')")
def lnk6_report(spark, d):
    """The states that a report shows, of two buckets (FLT4)."""
    b = table(spark, d, "bookmark")
    return linkcheck.reported(linkcheck.check(b, _responses(b)), ["status", "empty"])


@query(f"with {_CHECK}, rep as (select case {_REPORT} end as r from checked) select string_split(r, '|')[2] as label, count(*) as n from rep where r is not null group by 1")
def agg20_broken_groups(spark, d):
    b = table(spark, d, "bookmark")
    return linkcheck.by_label(linkcheck.reported(linkcheck.check(b, _responses(b))))


_VALID_SQL = f"rows as (select id, norm, url, title from ({duck.normalize('bookmark', 'url', 'norm', 'id, url, title')})), resp as ({_RESP} from (select norm, min(id) as k from rows group by norm)), v as (select *, coalesce(head_status > 0 and head_status < 400, false) or coalesce(get_status > 0 and get_status < 400, false) as valid from rows join resp using (norm))"


@query(f"with {_VALID_SQL} select id, valid from v where contains(lower(coalesce(title, '')), 'museum') or contains(lower(coalesce(url, '')), 'museum')")
def eng15_validated_search(spark, d):
    b = table(spark, d, "bookmark")
    return linkcheck.validated(search.search(b, "museum"), _responses(b))


@query(f"with {_VALID_SQL} select id, valid from v")
def lnk8_plain_probe(spark, d):
    b = table(spark, d, "bookmark")
    return linkcheck.validated(b, _responses(b))


@query(f"select count(*) as probed, count(distinct norm) as addresses from (select distinct norm from {_NB} where {duck.is_web('a')} and {duck.host_of('a')} <> '')")
def src19_probe(spark, d):
    """Every distinct address through a provider, which here answers 200 without a network."""
    r = linkcheck.probe(table(spark, d, "bookmark"), _answer_all)
    return r.where("head_status = 200").agg(F.count("*").alias("probed"), F.count_distinct("norm").alias("addresses"))


def _answer_all(addresses):
    for a in addresses:
        yield a, 200, None, None, a


# ---- labels


_CATEGORIES = ["dev", "docs", "news", "other"]


@query("select (p - 1) // 25 as batch, count(*) as n, count(distinct id) as ids, min(id) as first_id from (select id, row_number() over (order by id) as p from bookmark) group by 1")
def asy7_messages(spark, d):
    m = labels.messages(table(spark, d, "bookmark"), _CATEGORIES)
    b = m.select("batch", "n", F.explode(F.from_json("user", "categories array<string>, bookmarks array<struct<id: string, title: string, url: string>>")["bookmarks"]).alias("b"))
    return b.groupBy("batch", "n").agg(F.count_distinct("b.id").alias("ids"), F.min(F.col("b.id").cast("bigint")).alias("first_id"))


@query("select id, coalesce(title, '') as answer from bookmark")
def jsn4_answer_text(spark, d):
    """Titles inside chat answers of four forms, by the length of the title."""
    t, k = F.coalesce("title", F.lit("")), F.length(F.coalesce("title", F.lit(""))) % 4
    message = lambda c: F.to_json(F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("message"))).alias("choices")))
    raw = F.when(k == 0, message(t)).when(k == 1, message(F.array(F.struct(t.alias("text"))))).when(k == 2, F.to_json(F.struct(F.array(F.struct(t.alias("text"))).alias("choices")))).otherwise(F.to_json(F.struct(t.alias("content"))))
    return table(spark, d, "bookmark").select("id", labels.answer_text(raw).alias("answer"))


@query("select distinct lower(trim(source)) as name from bookmark where trim(source) <> ''")
def src20_model_names(spark, d):
    names = table(spark, d, "bookmark").where("trim(source) <> ''").select(F.lower(F.trim("source")).alias("s")).distinct()
    raw = names.select(F.when(F.length("s") % 3 == 0, F.to_json(F.array("s"))).when(F.length("s") % 3 == 1, F.to_json(F.struct(F.array(F.struct(F.col("s").alias("id"))).alias("data")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.col("s").alias("name"))).alias("models")))).alias("j"))
    return raw.select(F.explode(labels.model_names(F.col("j"))).alias("name"))


@query(f"with {_CLASS} select id, case when category in ({duck.strings(_CATEGORIES)}) then category else 'other' end as category, case when category in ({duck.strings(_CATEGORIES)}) then confidence else 0.2 end::double as confidence from cls")
def asy9_local_labels(spark, d):
    return labels.within(_classified(spark, d)[1], _CATEGORIES)


_LABELLED = f"""{_CLASS}, lab as (select id::varchar as id, case when date_added > 0 and trim(title) <> '' then 'docs' else category end as category, case when date_added > 0 and trim(title) <> '' then 'ai' else 'local' end as source from cls join bookmark using (id))"""


def _labelled(spark, d):
    """Labels from answers of a model that calls every dated row with a title ``docs`` and everything else ``nonsense``."""
    rows, c = _classified(spark, d)
    entry = F.struct(F.col("id").cast("string").alias("id"), F.when((F.col("date_added") > 0) & (F.trim("title") != ""), "docs").otherwise("nonsense").alias("category"), F.lit(0.9).alias("confidence"))
    answers = rows.select(F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.array(entry).alias("assignments"))), F.lit("\n```")).alias("answer"))
    return labels.label(rows, labels.assignments(answers, list(classify.TAXONOMY)), c)


@query(f"with {_LABELLED} select category, count(*) as n, count(*) filter (source = 'ai') as from_model, count(*) filter (source = 'local') as from_local from lab group by category")
def agg21_finish(spark, d):
    return labels.finished(_labelled(spark, d))


@query(f"with {_LABELLED} select case category when 'docs' then 'Papers' else category end as name, n, id from (select *, count(*) over (partition by category) as n from lab) where n >= 5")
def agg22_plan_from_labels(spark, d):
    return labels.plan_of(_labelled(spark, d), {"docs": "Papers"}, 5)


@query(r"select id, case when not regexp_matches(title, '[\x00-\x1f]') then title end as title from bookmark where title is not null and not contains(title, chr(92))")
def jsn2_repaired(spark, d):
    """Titles in single quotes behind a bare key and a trailing comma: quotes and brackets inside them survive, and raw control
    characters, which no JSON text may hold, make the answer unreadable."""
    t = F.col("title")
    j = F.concat(F.lit("{title: '"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("', n: [1, 2,], }"))
    b = table(spark, d, "bookmark").where(t.isNotNull() & ~F.contains(t, F.lit("\\")))
    return b.select("id", F.try_variant_get(text.parsed_json(j), "$.title", "string").alias("title"))

