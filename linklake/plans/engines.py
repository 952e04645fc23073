"""Queries of the composed operators (duplicates, trees, classification, plans, links, import, snapshots, search)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklake.functions import dates, text, urls
from linklake.operators import classify, dedupe, linkcheck, merge, planner, search, snapshots, tree
from linklake.plans import duck
from linklake.plans.general_problems import _DOWN, _NODES
from linklake.runtime import Workspace, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return Workspace(spark, "rows").put(dedupe.valid_rows(table(spark, d, "bookmark")))


_B = "bookmark"
_PATH = "coalesce(list_filter(string_split(path, '/'), lambda p: trim(p) <> ''), [])"
_N = f"norms as ({duck.normalize(_B, 'url', 'norm', 'id, title, url, date_added, path, a, ' + duck.trimmed('url') + ' as u')})"
_VALID = f"""{_N}, hosts as (select *, case when a is null then '' else {duck.host_of('a')} end as h, len({_PATH}) as depth from norms where u <> ''),
  valid as (select id, title, url, date_added, depth, norm, case when h = '' then '__unknown' else {duck.base_domain_of('h')} end as domain from hosts)"""
_HASH = """lpad(lower(to_hex(list_reduce(list_prepend(2166136261::ubigint, list_transform(flatten(list_transform(string_split({0}, ''), lambda c: case when c = '' then []::bigint[] when unicode(c) < 65536 then [unicode(c)::bigint]
  else [(55296 + (unicode(c) - 65536) // 1024)::bigint, (56320 + (unicode(c) - 65536) % 1024)::bigint] end)), lambda x: x::ubigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295::ubigint))), 8, '0')""".format
_EXACT = f"""{_VALID}, placed as (select *, count(*) over (partition by norm) as n, (row_number() over (partition by norm order by id) - 1) // 200 as chunk from valid),
  exact as (select *, count(*) over (partition by norm, chunk) as m, row_number() over (partition by norm, chunk order by depth, date_added nulls last, length(url), id::varchar) as r from placed where n > 1)"""


@query(f"with {_VALID} select id, norm, domain from valid")
def flt1_valid_rows(spark, d):
    return dedupe.valid_rows(table(spark, d, "bookmark")).select("id", "norm", "domain")


@query(f"select id, 'malformed bookmark' as reason from bookmark where coalesce({duck.trimmed('url')}, '') = ''")
def flt1_rejected_rows(spark, d):
    return dedupe.rejected_rows(table(spark, d, "bookmark"))


@query(f"""with {_EXACT} select 'exact-' || {_HASH('norm')} || (case when n > 200 then '-' || chunk else '' end) as group_id, id, case when r = 1 then 'keep' else 'remove' end as role,
  row_number() over (partition by norm, chunk order by r > 1, date_added desc nulls last, r) - 1 as place from exact where m > 1""")
def agg3_exact_groups(spark, d):
    return dedupe.exact_groups(_rows(spark, d)).select("group_id", "id", "role", "place")


@query(f"with {_VALID} select domain, count(*) as n, count(*) > 2000 as skipped from valid group by domain having count(*) > 1")
def agg4_domain_buckets(spark, d):
    return dedupe.buckets(dedupe.valid_rows(table(spark, d, "bookmark")))


_CAND = f"""{_VALID}, usable as (select domain from valid group by domain having count(*) between 2 and 2000),
  posts as (select v.domain, v.id, unnest({duck.tokens('title')}) as token from valid v semi join usable u on u.domain = v.domain),
  shared as (select p.domain, p.id, q.id as other, count(*) as shared from posts p join posts q on p.domain = q.domain and p.token = q.token and p.id <> q.id group by all),
  best as (select * from (select *, row_number() over (partition by domain, id order by shared desc, other) as r from shared) where r <= 40),
  pairs as (select distinct domain, least(id, other) as a, greatest(id, other) as b, shared from best)"""
_SCORED = f"""{_CAND}, feats as materialized (select *, {duck.grams('s')} as gs, {duck.grams('w')} as gw from (select id, norm, {duck.tokens('title')} as k, {duck.squeezed('title')} as s, {duck.squeezed('norm')} as w from valid)),
  scored as materialized (select p.domain, p.a, p.b, 0.5 * {duck.jaccard('x.k', 'y.k')} + 0.2 * {duck.dice_sets('x.s', 'y.s', 'x.gs', 'y.gs')} + 0.3 * {duck.dice_sets('x.w', 'y.w', 'x.gw', 'y.gw')} as score
             from pairs p join feats x on x.id = p.a join feats y on y.id = p.b where x.norm <> y.norm)"""
_SIMILAR = f"""{_SCORED}, edges as (select * from scored where score >= 0.82), sym as (select a as u, b as v from edges union select b, a from edges),
  walk as (select u as id, u as up from sym union select w.id, s.v from walk w join sym s on s.u = w.up),
  roots as (select id, min(up) as root from walk group by id),
  means as (select r.root, round(avg(e.score), 3) as score from edges e join roots r on r.id = e.a group by r.root),
  pieced as (select v.*, r.root, m.score, (row_number() over (partition by r.root order by v.id::varchar) - 1) // 200 as piece from valid v join roots r using (id) join means m using (root))"""


@query(f"with {_CAND} select domain, a, b, shared from pairs")
def jn1_candidate_pairs(spark, d):
    return dedupe.candidate_pairs(_rows(spark, d))


@query(f"with {_SCORED} select a, b, round(score, 6) as score from scored")
def jn2_scored_pairs(spark, d):
    return dedupe.scored_pairs(_rows(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


@query(f"with recursive {_SIMILAR} select domain, root, id, score, case when row_number() over w = 1 then 'keep' else 'remove' end as role from pieced window w as (partition by root, piece order by depth, date_added nulls last, length(url), id::varchar)")
def eng1_similar_groups(spark, d):
    return dedupe.similar_groups(_rows(spark, d)).select("domain", "root", "id", "score", "role")


_NAMED = f"""{_SIMILAR}, ex as (select * from (select *, count(*) over (partition by norm, chunk) as m, row_number() over (partition by norm, chunk order by depth, date_added nulls last, length(url), id::varchar) as r
    from (select *, count(*) over (partition by norm) as n, (row_number() over (partition by norm order by id) - 1) // 200 as chunk from valid)) where n > 1 and m > 1),
  sim as (select *, count(*) over (partition by root, piece) as m, row_number() over (partition by root, piece order by depth, date_added nulls last, length(url), id::varchar) as r, max(piece) over (partition by root) as last from pieced),
  ids as (select domain, root, piece, string_agg(id::varchar, ',' order by id::varchar) as ids from sim where m > 1 group by all),
  dups as (select 'exact' as kind, 'exact-' || {_HASH('norm')} || (case when n > 200 then '-' || chunk else '' end) as group_id, norm as key, 1.0::double as score, id, case when r = 1 then 'keep' else 'remove' end as role, date_added from ex
    union all select 'similar', 'similar-' || {_HASH("(i.domain || ':' || i.ids)")} || (case when last > 0 then '-' || s.piece else '' end), i.domain || ':' || {_HASH('i.ids')}, s.score::double, s.id, case when r = 1 then 'keep' else 'remove' end, s.date_added from sim s join ids i using (root, piece))"""


@query(f"with recursive {_NAMED} select kind, group_id, key, score, id, role from dups")
def eng1_find_duplicates(spark, d):
    return dedupe.find_duplicates(table(spark, d, "bookmark")).select("kind", "group_id", "key", "score", "id", "role")


@query(f"with recursive {_NAMED} select group_id, count(*) as n from dups group by group_id")
def srt1_groups_by_size(spark, d):
    return dedupe.by_size(dedupe.find_duplicates(table(spark, d, "bookmark")))


@query(f"with recursive {_NAMED} select group_id, id, row_number() over (partition by group_id order by date_added desc nulls last, id) - 1 as shown_at from dups where kind = 'exact'")
def srt5_shown_duplicates(spark, d):
    b = table(spark, d, "bookmark")
    return dedupe.shown(dedupe.find_duplicates(b, include_similar=False), b)


@query(f"with recursive {_SIMILAR} select id, root from roots")
def eng3_components(spark, d):
    rows = _rows(spark, d)
    return dedupe.connected(Workspace(spark, "edges").put(dedupe.scored_pairs(rows).where("score >= 0.82")))


@query(f"""with {_SCORED}, e as (select norm, count(*) as n from valid group by norm having count(*) > 1)
  select (select count(*) from valid) as scanned, (select coalesce(sum(n // 200 + (n % 200 > 1)::int), 0)::bigint from e) as exact_groups, (select count(*) from scored) as candidate_pairs,
         (select count(*) from (select domain from valid group by domain having count(*) > 2000)) as skipped_buckets""")
def agg6_dedupe_statistics(spark, d):
    return dedupe.statistics(table(spark, d, "bookmark"))


for _rule, _order in {"oldest": "coalesce(date_added, 0)", "newest": "coalesce(date_added, 0) desc", "longestUrl": "length(url) desc", "shortestUrl": "length(url)", "longestTitle": "length(coalesce(title, '')) desc", "shortestTitle": "length(coalesce(title, ''))"}.items():
    _name = f"agg23_keep_{_rule}"
    QUERIES[_name] = lambda spark, d, rule=_rule: dedupe.smart_keep(dedupe.valid_rows(table(spark, d, "bookmark")), rule)
    ORACLES[_name] = f"with {_VALID} select norm, id as keep_id from (select *, count(*) over (partition by norm) as n, row_number() over (partition by norm order by {_order}, id) as r from valid) where n > 1 and r = 1"

# ---- trees
_LINK = "coalesce(trim(url) <> '', false)"
_LOC = f"""with recursive {_NODES}, loc as (select t.id, 0 as depth, []::varchar[] as path, coalesce(trim(t.title), '') as own from tree t where parent is null
  union all select t.id, l.depth + 1, list_concat(l.path, [l.own]), coalesce(trim(t.title), '') from tree t join loc l on t.parent = l.id),
  place as (select id, depth, array_to_string(list_filter(path, lambda s: s <> ''), '/') as path from loc)"""


@query(f"{_LOC} select c.id, case when trim(c.title) <> '' then c.title else c.url end as title, c.url, coalesce(c.date_added, 0) as date_added, p.path from cur c left join place p using (id) where {_LINK}")
def src6_bookmarks(spark, d):
    return tree.bookmarks(table(spark, d, "nodes")).select("id", "title", "url", "date_added", F.array_join("path", "/").alias("path"))


@query(f"{_LOC} select c.id, c.title, (select count(*) from cur k where k.parent_id = c.id) as child_count, p.path from cur c left join place p using (id) where not {_LINK} and trim(c.title) <> ''")
def src6_folders(spark, d):
    return tree.folders(table(spark, d, "nodes")).select("id", "title", "child_count", F.array_join("path", "/").alias("path"))


@query(f"with {_NODES} select id, parent_id, idx, title, url from cur where parent_id = (select max(parent_id) from nodes)")
def src2_children(spark, d):
    n = table(spark, d, "nodes")
    return tree.children(n, n.agg(F.max("parent_id")).first()[0])


@query(f"with {_NODES} select count(*) filter ({_LINK}) as bookmarks, count(*) filter (not {_LINK}) as folders, count(*) as total from cur")
def agg17_count_nodes(spark, d):
    return tree.counts(table(spark, d, "nodes"))


@query(f"with {_NODES} select parent_id, lower(title) as name, count(*) as n, min(id) as first_id from cur where not {_LINK} and trim(title) <> '' and trim(parent_id) <> '' group by 1, 2 having count(*) > 1")
def agg7_duplicate_folders(spark, d):
    return tree.duplicate_folders(table(spark, d, "nodes"))


@query(f"""with recursive {_NODES}, {_DOWN}, links as (select c.id from cur c where {_LINK}), up as (select t.id, t.parent from tree t join links using (id) union select p.id, p.parent from up u join tree p on p.id = u.parent)
  select d.id, d.depth from down d join cur c using (id) where not {_LINK} and d.id not in (select id from up)""")
def eng5_empty_folders(spark, d):
    return tree.empty_folders(table(spark, d, "nodes"))


@query(f"""with recursive {_NODES}, r as (select min(t.id) as id from tree t where t.parent is null and not exists (select 1 from cur c where c.id = t.id and coalesce(trim(c.url) <> '', false))),
  below as (select t.id from tree t join r on t.parent = r.id union all select t.id from tree t join below b on t.parent = b.id)
  select distinct title from cur join below using (id) where not {_LINK} and trim(title) <> ''""")
def agg24_descendant_titles(spark, d):
    n = Workspace(spark, "nodes").put(table(spark, d, "nodes"))
    cur = tree.hierarchy.current_nodes(n)
    roots = cur.where(tree.is_folder()).join(cur.select(F.col("id").alias("parent_id"), F.lit(True).alias("k")), "parent_id", "left").where("k is null")
    return tree.descendant_titles(n, roots.agg(F.min("id")).first()[0])


@query(f"with {_NODES} select id, case when idx % 7 = 3 then 'trash' else parent_id end as parent_id, idx from cur")
def dml1_move(spark, d):
    cur = tree.hierarchy.current_nodes(table(spark, d, "nodes"), ["parent_id", "idx", "title", "url", "date_added"])
    return tree.move(cur, cur.where("idx % 7 = 3").select("id", F.lit("trash").alias("to_parent")))[0].select("id", "parent_id", "idx")


@query(f"with {_NODES} select id, parent_id, idx from cur")
def dml3_undo(spark, d):
    cur = Workspace(spark, "cur").put(tree.hierarchy.current_nodes(table(spark, d, "nodes"), ["parent_id", "idx"]))
    new, log = tree.move(cur, cur.where("idx % 7 = 3").select("id", F.lit("trash").alias("to_parent")))
    return tree.undo(new, log).select("id", "parent_id", "idx")


@query(f"with {_NODES} select id from cur where id not in (select id from cur where trim(url) = '' or url is null)")
def dml5_delete(spark, d):
    cur = tree.hierarchy.current_nodes(table(spark, d, "nodes"))
    return tree.delete(cur, cur.where(tree.is_folder())).select("id")


@query(f"""with {_NODES}, want as (select distinct parent_id, 'Archive' as title from cur where {_LINK} and parent_id is not null)
  select w.parent_id, w.title from want w anti join (select parent_id, title from cur where not {_LINK}) h on h.parent_id = w.parent_id and h.title = w.title""")
def dml6_ensure_folders(spark, d):
    cur = tree.hierarchy.current_nodes(table(spark, d, "nodes"))
    want = cur.where(~tree.is_folder() & F.col("parent_id").isNotNull()).select("parent_id", F.lit("Archive").alias("title"))
    return tree.ensure_folders(cur, want).select("parent_id", "title")


# ---- classification: hosts of the test data belong to no category, so links get one of a few listed hosts by id
_LISTED = ["github.com", "gist.github.com", "www.youtube.com", "news.bbc.co.uk", "de.wikipedia.org", "unknown.example"]


def _listed(spark, d):
    b = table(spark, d, "bookmark")
    host = F.element_at(F.array(*map(F.lit, _LISTED)), (F.col("id") % len(_LISTED) + 1).cast("int"))
    return b.withColumn("url", F.concat(F.lit("https://"), host, F.lit("/"), F.regexp_replace(F.coalesce("url", F.lit("")), r"^\s*(?i:https?)://[^/]*/", "")))


_DIM = ", ".join(f"({p}, '{c}', '{k}', '{t}')" for p, c, k, t in classify.taxonomy_rows())
_PICK = "list_extract([" + ", ".join(f"'{h}'" for h in _LISTED) + f"], (id % {len(_LISTED)} + 1)::int)"
_CLASS = rf"""dim(place, category, kind, term) as (values {_DIM}),
  src as (select id, title, path, 'https://' || {_PICK} || '/' || regexp_replace(coalesce(url, ''), '^\s*(?i:https?)://[^/]*/', '') as url from bookmark),
  base0 as (select *, {duck.absolute('url')} as a from src),
  r as (select id, left(coalesce(title, ''), 500) as title, left(lower(url), 1500) as low, regexp_replace({duck.host_of('a')}, '^www\.', '') as host,
        coalesce(lower(regexp_extract(a, '^(?i:https?)://[^/?#]*([^?#]*)', 1)), '') || ' ' || lower(array_to_string({_PATH}, '/')) as hay from base0),
  ends as (select id, i as rank, array_to_string(list_slice(string_split(host, '.'), i, -1), '.') as term from (select id, host, unnest(range(1, greatest(len(string_split(host, '.')), 2))) as i from r)),
  hm as (select id, arg_min(place, rank) as place, arg_min(category, rank) as category from ends join dim using (term) where kind = 'host' group by id),
  tt as (select id, unnest({duck.tokens('title')}) as term from r), ut as (select id, unnest({duck.tokens('low')}) as term from r),
  bd as (select {duck.base_domain_of('term')} as term, min(place) as place, arg_min(category, place) as category from dim where kind = 'host' group by 1),
  sig as (select id, place, category, 10 as points from hm
    union all select id, place, category, 6 from (select id, {duck.base_domain_of('host')} as term from r anti join hm using (id)) join bd using (term)
    union all select id, place, category, least(count(*) * 3, 6) from r join dim on kind = 'path' and contains(hay, dim.term) group by id, place, category
    union all select id, place, category, least(count(*) * 2, 6) from tt join dim using (term) where kind = 'title' group by id, place, category
    union all select p.id, p.place, p.category, p.k from (select id, place, category, least(count(*) * 2, 4) as k from r join dim on kind = 'phrase' and contains(lower(title), dim.term) group by id, place, category) p anti join hm on hm.id = p.id and hm.category = p.category
    union all select u.id, u.place, u.category, case when hm.category = u.category then least(u.k, 2) else u.k end from (select id, place, category, least(count(*), 3) as k from ut join dim using (term) where kind = 'url' group by id, place, category) u left join hm using (id)),
  tot as (select id, place, category, sum(points) as score from sig group by id, place, category),
  top as (select * from (select *, row_number() over (partition by id order by score desc, place) as rn from tot) where rn = 1),
  cls as (select b.id, case when score >= 2 then category else 'other' end as category, case when score >= 2 then round(least(0.97, 0.45 + 0.05 * score::double), 2)::double when score > 0 then 0.25 else 0.15 end as confidence from bookmark b left join top using (id))"""


def _classified(spark, d):
    rows = Workspace(spark, "listed").put(_listed(spark, d))
    return rows, classify.classify(rows)


@query(f"with {_CLASS} select id, category, confidence from cls")
def eng7_classify(spark, d):
    return _classified(spark, d)[1].select("id", "category", "confidence")


@query(f"with {_CLASS} select category, count(*) as n, round(avg(confidence), 3) as avg_confidence from cls group by category")
def agg10_classify_summary(spark, d):
    return classify.summary(_classified(spark, d)[1])


@query(f"""with {_CLASS}, k as (select {duck.base_domain_of('host')} as host, category, confidence from r join cls using (id) where host <> ''),
  v as (select host, category, count(*) as k, sum(confidence) as c from k group by 1, 2), t as (select *, sum(k) over (partition by host) as n, row_number() over (partition by host order by k desc, category desc) as rn from v)
  select host, category, n::bigint as n, round(k / n, 2) as ratio, round(c / k, 2) as confidence from t where rn = 1 and n >= 3 and category <> 'other' and k >= 0.6 * n""")
def agg11_suggest_rules(spark, d):
    rows, c = _classified(spark, d)
    return classify.suggest_rules(rows, c)


_RULES = [("wikilore", "Wiki"), ("/docs/", "Docs"), ("archive", "Archive")]


@query("select id, case when contains(x, 'wikilore') then 'Wiki' when contains(x, '/docs/') then 'Docs' when contains(x, 'archive') then 'Archive' else 'rest' end as folder from (select id, lower(coalesce(url, '') || ' ' || coalesce(title, '')) as x from bookmark)")
def jn15_custom_rules(spark, d):
    hay = F.concat(F.coalesce("url", F.lit("")), F.lit(" "), F.coalesce("title", F.lit("")))
    return table(spark, d, "bookmark").select("id", classify.first_rule(_RULES, hay, "rest").alias("folder"))


# ---- plans
_AT = "coalesce(epoch_ms(case when ms between -62135596800000 and 253402300799999 then ms end), case when year(epoch_ms(id)) between 1990 and 2100 and id > 0 then epoch_ms(id) end)"
_SAFE = r"""(case when {0} <> '' then {0} else 'ungrouped' end)"""
_CLEANED = r"""trim(left(regexp_replace(trim(regexp_replace({0}, '[\x00-\x1F\x7F\\/:*?"<>|]', '', 'g')), '\s+', ' ', 'g'), 80))"""


def _plan_sql(raw: str) -> str:
    return f"""src as (select *, {duck.absolute('url')} as a, case when date_added <= 10000000000 then date_added * 1000 else date_added end as ms, {_PATH} as ps from bookmark),
  seg as (select id, case when ps[1] = 'Bar' then 'filed' else 'movable' end as status, list_transform({raw}, lambda s: {_SAFE.format(_CLEANED.format('s'))}) as segments from (select *, case when a is null then '' else {duck.host_of('a')} end as h, {_AT} as moment from src)),
  keyed as (select *, lower(array_to_string(segments, '\x01')) as group_key from seg), sizes as (select group_key, count(*) as n, min(segments) as shown from keyed where status = 'movable' group by group_key),
  planned as (select k.id, case when k.status = 'movable' and n < 2 then 'small' else k.status end as status, k.group_key, segments, case when k.status = 'movable' and n >= 2 then list_concat(['Bar'], shown) end as to_folder from keyed k left join sizes using (group_key))"""


_STRATEGIES = {
    "domain": f"[case when h = '' then 'unknown' else {duck.base_domain_of('h')} end]",
    "date": "case when moment is null then ['unknown-date'] else [lpad(year(moment)::varchar, 4, '0'), lpad(year(moment)::varchar, 4, '0') || '-' || lpad(month(moment)::varchar, 2, '0')] end",
    "folder": "[coalesce(ps[1], 'unfiled')]",
}
for _s, _raw in _STRATEGIES.items():
    QUERIES[f"eng11_plan_by_{_s}"] = lambda spark, d, s=_s: planner.plan(table(spark, d, "bookmark"), s, root=["Bar"], only_unfiled=False, monthly=True).select("id", "status", F.array_join("to_folder", "/").alias("to_folder"))
    ORACLES[f"eng11_plan_by_{_s}"] = f"with {_plan_sql(_raw)} select id, status, array_to_string(to_folder, '/') as to_folder from planned"


def _planned(spark, d, strategy="date"):
    return Workspace(spark, "plan").put(planner.plan(table(spark, d, "bookmark"), strategy, root=["Bar"], only_unfiled=False, monthly=True))


_PD = _plan_sql(_STRATEGIES["date"])


@query(f"""with {_PD}, leaf as (select to_folder, count(*) as k from planned where to_folder is not null group by 1), each as (select list_slice(to_folder, 1, i) as p, case when i = len(to_folder) then k else 0 end as k from (select *, unnest(range(1, len(to_folder) + 1)) as i from leaf))
  select array_to_string(p, '/') as path, p[-1] as name, sum(k)::bigint as n from each group by p""")
def agg13_plan_folders(spark, d):
    return planner.folders(_planned(spark, d))


@query(f"with {_plan_sql(_STRATEGIES['folder'])} select group_key, array_to_string(list_sort(list_distinct(list(segments[-1]))), ' / ') as names from planned where status in ('movable', 'small') group by group_key having count(distinct segments[-1]) > 1")
def agg14_plan_conflicts(spark, d):
    return planner.conflicts(_planned(spark, d, "folder"))


@query(f"with {_PD} select count(*) as total, count(*) filter (status = 'movable') as movable, count(*) filter (status = 'filed') as already_filed, count(*) filter (status in ('skipped', 'small')) as skipped, coalesce(max(case when to_folder is not null then len(segments) end), 0)::int as max_depth from planned")
def agg15_plan_statistics(spark, d):
    return planner.statistics(_planned(spark, d))


@query(f"""with {_PD}, leaf as (select distinct to_folder from planned where to_folder is not null), each as (select distinct array_to_string(list_slice(to_folder, 1, i), '/') as path from (select *, unnest(range(1, len(to_folder) + 1)) as i from leaf))
  select path from each where path not in (select distinct array_to_string({_PATH}, '/') from bookmark)""")
def jn7_missing_folders(spark, d):
    have = table(spark, d, "bookmark").select(F.array_join(dates.path_array(F.col("path")), "/").alias("path")).distinct()
    return planner.missing_folders(_planned(spark, d), have)


@query(f"with {_PD} select p.id, array_to_string(to_folder, '/') as expected, array_to_string({_PATH}, '/') as actual from planned p join bookmark b using (id) where to_folder is not null and {_PATH} is distinct from to_folder")
def jn6_verify(spark, d):
    return planner.verify(_planned(spark, d), table(spark, d, "bookmark").select("id", dates.path_array(F.col("path")).alias("path")))


@query(f"select name, count(*) as n, min(id) as first_id from (select id, case when h = '' then 'other' else {duck.base_domain_of('h')} end as name from (select id, case when a is null then '' else {duck.host_of('a')} end as h from (select id, {duck.absolute('url')} as a from bookmark))) group by name having count(*) >= 2")
def agg18_archive_groups(spark, d):
    key = urls.let(urls.base_domain(F.col("url")), lambda h: F.when(h != "", h))
    return planner.rule_groups(table(spark, d, "bookmark"), key, min_size=2)


@query("select name, count(*) as n, min(id) as first_id from (select id, case when y is null then 'unknown' when y >= 2025 then 'this year' when y = 2024 then 'last year' else y::varchar end as name from (select id, year(epoch_ms(case when date_added between -62135596800000 and 253402300799999 then nullif(date_added, 0) end)) as y from bookmark)) group by name having count(*) >= 2")
def agg19_date_groups(spark, d):
    return planner.rule_groups(table(spark, d, "bookmark"), dates.year_bucket(F.col("date_added"), 2025), min_size=2)


# ---- link states over responses recorded by rule
_NB = f"({duck.normalize(_B, 'url', 'norm', 'id, a')})"
_RESP = """select norm, case k % 8 when 0 then 200 when 1 then 404 when 2 then 403 when 3 then 503 when 4 then 301 when 5 then null when 6 then -1 else 405 end::int as head_status,
  case k % 3 when 0 then 200 when 1 then 410 else 500 end::int as get_status, case when k % 5 = 0 then 200 else 502 end::int as retry_status, case when k % 4 = 0 then norm || '/moved' else norm end as final_url"""


def _responses(rows: DataFrame) -> DataFrame:
    k = rows.select("id", urls.normalize(F.col("url")).alias("norm")).groupBy("norm").agg(F.min("id").alias("k"))
    return k.selectExpr(*[x.strip() for x in (
        "norm", "cast(case k % 8 when 0 then 200 when 1 then 404 when 2 then 403 when 3 then 503 when 4 then 301 when 5 then null when 6 then -1 else 405 end as int) as head_status",
        "cast(case k % 3 when 0 then 200 when 1 then 410 else 500 end as int) as get_status", "cast(case when k % 5 = 0 then 200 else 502 end as int) as retry_status",
        "case when k % 4 = 0 then concat(norm, '/moved') else norm end as final_url")])


_CHECK = f"""rows as (select id, norm, case when a is null then 'empty' when {duck.is_web('a')} then (case when {duck.host_of('a')} = '' then 'invalid' else 'http' end) else 'other' end as kind from {_NB}),
  resp as ({_RESP} from (select norm, min(id) as k from rows group by norm)), f as (select *, case when head_status in (-1, 400, 403, 405, 406, 501) then get_status else head_status end as s1 from resp),
  g as (select *, case when s1 between 500 and 599 then coalesce(retry_status, s1) else s1 end as st from f),
  checked as (select id, case when kind = 'empty' then 'empty' when kind = 'invalid' then 'invalid' when kind = 'other' then 'unsupported' when st is null then 'timeout' when st between 200 and 299 then (case when final_url <> norm then 'redirect' else 'ok' end)
    when st between 300 and 399 then 'redirect' when st in (401, 403, 429) then 'blocked' when st between 500 and 599 then 'server_error' else 'broken' end as status, case when kind = 'http' then st end as http_status from rows left join g using (norm))"""


@query(f"with {_CHECK} select id, status, http_status from checked")
def lnk5_scan(spark, d):
    b = table(spark, d, "bookmark")
    return linkcheck.check(b, _responses(b)).select("id", "status", "http_status")


@query(f"with {_CHECK} select {', '.join(f"count(*) filter (status = '{s}') as {s}" for s in linkcheck.STATES)}, count(*) as total, count(*) filter (status in ('empty', 'invalid', 'unsupported')) as skipped from checked")
def agg16_link_summary(spark, d):
    b = table(spark, d, "bookmark")
    return linkcheck.summary(linkcheck.check(b, _responses(b)))


# ---- import: even ids are the library, odd ones the batch
_K = f"kn as (select id, a, norm, case when coalesce({duck.is_web('a')} and {duck.host_of('a')} <> '', false) then norm end as k from {_NB})"


@query(f"""with {_K}, f as (select k, min(id) as first from kn where k is not null group by k) select id, case when a is null then 'missing url' when kn.k is null then 'invalid url' end as error, case when first < id then first end as duplicate_of from kn left join f using (k)""")
def agg26_validate(spark, d):
    return merge.validate(table(spark, d, "bookmark"))


for _p, _case in {"skip": "when h.k is not null or first < id then 'skipped'", "overwrite": "when h.k is not null and not first < id then 'replaced'", "duplicate": ""}.items():
    QUERIES[f"dml9_import_{_p}"] = lambda spark, d, p=_p: merge.plan_import(table(spark, d, "bookmark").where("id % 2 = 1"), table(spark, d, "bookmark").where("id % 2 = 0"), p)
    ORACLES[f"dml9_import_{_p}"] = f"with {_K}, h as (select distinct k from kn where id % 2 = 0 and k is not null), n as (select * from kn where id % 2 = 1), f as (select k, min(id) as first from n where k is not null group by k) select id, case when n.k is null then 'failed' {_case} else 'created' end as action from n left join h on h.k = n.k left join f on f.k = n.k"


@query(f"""with {_K}, n as (select kn.id, kn.k from kn where id % 2 = 1 and k is not null) select id, 'import' as origin from n union all select id, 'library' from kn where id % 2 = 0 and (k is null or k not in (select k from n))""")
def jn3_merged_overwrite(spark, d):
    b = table(spark, d, "bookmark")
    return merge.merged(b.where("id % 2 = 1"), b.where("id % 2 = 0"), "overwrite").select("id", "origin")


# ---- snapshots
@query("select snapshot_id, library_id, place from (select *, row_number() over (partition by library_id order by created_at desc nulls last, snapshot_id) as place from (select distinct snapshot_id, library_id, created_at from snapshots)) where place <= 5")
def snk8_newest_snapshots(spark, d):
    return snapshots.newest(table(spark, d, "snapshots")).select("snapshot_id", "library_id", "place")


_LAST = "(select * from (select *, row_number() over (partition by snapshot_id, id order by loaded_at desc nulls last, parent_id desc nulls last, idx desc nulls last, title desc nulls last, url desc nulls last) as rn from node_snapshots) where rn = 1)"


@query(f"select snapshot_id, count(*) filter (coalesce(url <> '', false)) as bookmarks, count(*) filter (not coalesce(url <> '', false)) as folders, count(*) as total from {_LAST} group by snapshot_id")
def dml13_snapshot_counts(spark, d):
    return snapshots.counts(table(spark, d, "node_snapshots"))


@query(f"with s as (select * from {_LAST} where snapshot_id = (select max(snapshot_id) from node_snapshots)) select 'r' || s.id as id, coalesce('r' || p.id, s.parent_id) as parent_id, s.idx, s.title, s.url from s left join s p on p.id = s.parent_id")
def dml14_restore(spark, d):
    rows = table(spark, d, "node_snapshots")
    return snapshots.restore(rows, rows.agg(F.max("snapshot_id")).first()[0])


# ---- search, sets, paging
@query("select id from bookmark where contains(lower(coalesce(title, '')), 'archive') or contains(lower(coalesce(url, '')), 'archive')")
def flt5_search(spark, d):
    return search.search(table(spark, d, "bookmark"), "Archive").select("id")


@query("select id from bookmark where contains(lower(coalesce(title, '') || ' ' || coalesce(url, '')), 'museum') or contains(lower(coalesce(title, '') || ' ' || coalesce(url, '')), '目录')")
def flt6_any_keyword(spark, d):
    return search.any_keyword(table(spark, d, "bookmark"), "Museum，目录").select("id")


@query(f"select id from bookmark where coalesce(url <> '', false) and not list_contains({_PATH}, 'Inbox')")
def flt2_outside_folder(spark, d):
    return search.outside(table(spark, d, "bookmark"), "Inbox").select("id")


@query("select id, title from bookmark order by date_added desc nulls last, id limit 20 offset 40")
def lim1_page(spark, d):
    return search.page(table(spark, d, "bookmark"), [F.col("date_added").desc_nulls_last(), "id"], 20, 3).select("id", "title")


@query("select id, (row_number() over (order by id) - 1) // 25 as chunk from bookmark")
def arr4_chunks(spark, d):
    return search.chunked(table(spark, d, "bookmark").select("id"), ["id"], 25)


@query(f"select distinct {_PATH}[1] as name from bookmark where len({_PATH}) > 0 union select distinct title from nodes where trim(title) <> '' and not {_LINK}")
def set1_folder_names(spark, d):
    first = table(spark, d, "bookmark").select(F.try_element_at(dates.path_array(F.col("path")), F.lit(1)).alias("name")).where("name is not null")
    return first.union(table(spark, d, "nodes").where(tree.is_folder() & (F.trim("title") != "")).select("title")).distinct()


@query("select source, count(*) as n from (select lower(trim(source)) as source from bookmark) group by source")
def agg1_group_by(spark, d):
    return table(spark, d, "bookmark").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"))


@query("select path, min(id) as id from bookmark where path is not null group by path")
def agg2_unique_by(spark, d):
    return table(spark, d, "bookmark").where("path is not null").groupBy("path").agg(F.min("id").alias("id"))
