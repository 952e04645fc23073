import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from linklake.operators import dedupe, hierarchy, hot_keys, linkcheck, merge, ordering, planner, snapshot_diff, snapshots, tree
from linklake.operators import classify as classes
from linklake.operators import labels as label_ops
from linklake.sources import netscape

T = datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def links(spark, data):
    return spark.createDataFrame(data, "id bigint, title string, url string, date_added bigint, path string")


# ---- keys that hold most rows
def test_per_key_against_counting(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 8 + [None, "a", "b", "c"]), rng.choice([None, "p", "q", "r"]), rng.choice([None, 1, 5, 1 << 40])) for _ in range(500)]
    df = spark.createDataFrame(data, "key string, n_rows string, at bigint").repartition(5)
    want = sorted((k, sum(x[0] == k for x in data), len({x[1] for x in data if x[0] == k and x[1]}), max((x[2] for x in data if x[0] == k and x[2]), default=None)) for k in {x[0] for x in data} - {None})
    for blocks in (1, 7):
        assert rows(hot_keys.per_key(df, F.col("key"), F.col("n_rows"), F.col("at"), blocks)) == want
    assert rows(hot_keys.per_key(df.limit(0), F.col("key"), F.col("n_rows"), F.col("at"))) == []
    one = spark.createDataFrame([("x", "p", None)], "key string, item string, at bigint")
    assert rows(hot_keys.per_key(one, F.col("key"), F.col("item"), F.col("at"))) == [("x", 1, 1, None)]


# ---- neighbours and numbers in groups
def test_ordering_against_windows(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot"] * 6 + [None, "b"]), rng.randrange(5), i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, t int, i bigint").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["i"]: (r["next"], r["is_first"]) for r in ordering.next_in_group(df, ["g"], ["t", "i"], "i").collect()}
        place = {r["i"]: r["place"] for r in ordering.number_in_group(df, ["g"], ["t", "i"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for g in {x[0] for x in data}:
        seq = [i for _, i in sorted((t, i) for k, t, i in data if k == g)]
        assert [got[i][0] for i in seq] == seq[1:] + [None]
        assert [got[i][1] for i in seq] == [True] + [False] * (len(seq) - 1)
        assert [place[i] for i in seq] == list(range(len(seq)))


# ---- snapshots
SNAP = "snapshot_id string, library_id string, created_at timestamp, action string"
NODE = "snapshot_id string, id string, parent_id string, idx int, title string, url string, loaded_at timestamp"


def test_snapshot_diff(spark):
    s = spark.createDataFrame([("z", "L", datetime(2020, 1, 1), None), ("a", "L", datetime(2020, 2, 1), "x"), ("a", "L", datetime(2020, 2, 1), "x"), ("e", "L", datetime(2020, 3, 1), None), ("m", "M", datetime(2020, 1, 1), None)], SNAP)
    n = spark.createDataFrame([
        ("z", "1", None, 0, "t", "u", T), ("z", "2", "1", 0, None, "u", T), ("z", "3", "1", 0, "x", "u", T),
        ("a", "1", None, 9, "t", "u", T), ("a", "1", None, 9, "t", "u", T), ("a", "2", "1", 0, "", "u", T), ("a", "4", "1", 0, "old", "u", T), ("a", "4", "1", 0, "new", "u", None),
        ("m", "1", None, 0, "t", "u", T), ("nobody", "1", None, 0, "t", "u", T), ("a", None, None, 0, "t", "u", T)], NODE)
    assert rows(snapshot_diff.diff_all(s, n)) == [("a", "2", "changed"), ("a", "3", "removed"), ("a", "4", "added"), ("e", "1", "removed"), ("e", "2", "removed"), ("e", "4", "removed")]
    assert rows(snapshot_diff.diff_all(s, n.limit(0))) == [] and rows(snapshot_diff.diff_all(s.limit(0), n)) == []
    assert rows(snapshot_diff.replay(s, n)) == rows(snapshot_diff.diff_all(s, n))
    assert rows(snapshot_diff.replay(s, n.limit(0))) == [] and rows(snapshot_diff.replay(s.limit(0), n)) == []


def test_snapshot_index_swaps(spark):
    index = snapshot_diff.SnapshotIndex(spark, ["id"], ["parent_id", "title", "url"], "loaded_at", buckets=2)
    day = lambda *r: spark.createDataFrame([("s", *x, T) for x in r], NODE)
    try:
        assert [r["change_kind"] for r in index.apply(day(("1", None, 0, "t", "u"))).collect()] == ["added"]
        second = {r["id"]: r for r in index.apply(day(("1", None, 0, "T", "u"), ("2", "1", 0, "t", "u"))).collect()}
        assert second["1"]["change_kind"] == "changed" and second["1"]["old"]["title"] == "t" and second["1"]["new"]["title"] == "T"
        assert second["2"]["change_kind"] == "added" and second["2"]["old"] is None
        third = {r["id"]: r["change_kind"] for r in index.apply(day(("2", "1", 5, "t", "u"))).collect()}
        assert third == {"1": "removed"}
    finally:
        index.drop()


def test_snapshot_restore_and_prune(spark):
    n = spark.createDataFrame([("s", "1", None, 0, "f", None, T), ("s", "2", "1", 0, "t", "u", T), ("s", "2", "1", 0, "t", "u", T), ("q", "9", "x", 0, "t", "u", T)], NODE)
    assert rows(snapshots.restore(n, "s").select("id", "parent_id")) == [("r1", None), ("r2", "r1")]
    assert rows(snapshots.counts(n)) == [("q", 1, 0, 1), ("s", 1, 1, 2)]


# ---- hierarchies
TREE = "id string, parent_id string, idx int, title string, url string, date_added bigint, library_id string, loaded_at timestamp"


def brute(parents):
    out = {}
    for i in parents:
        seen, at = [], i
        while at is not None and at not in seen:
            seen.append(at)
            at = parents[at] if parents[at] in parents else None
        out[i] = (seen[-1], len(seen) - 1) if at is None else (min(seen[seen.index(at):]), -1)
    return out


def climb(parents, at, stop=()):
    """Nodes from ``at`` upwards, up to a repetition or past a node of ``stop``."""
    seen = []
    while at in parents and at not in seen:
        seen.append(at)
        at = None if at in stop else parents[at]
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_walking(spark, seed):
    rng = random.Random(seed)
    ids = [f"{i:03}" for i in range(120)]
    parents = {i: rng.choice([None, "", "gone", *ids, *ids, *ids]) for i in ids} | {f"c{k:02}": f"c{k - 1:02}" for k in range(70)}
    df = spark.createDataFrame([(i, p, rng.choice([None, 1, 1, 2]), rng.choice([None, "", "t"]), None, None, None, T) for i, p in parents.items()], TREE)
    clean = {i: p or None for i, p in parents.items()}
    want = brute(clean)
    got = {r["id"]: r for r in hierarchy.full_hierarchy(df).collect()}
    assert {i: (r["root_id"], r["depth"]) for i, r in got.items()} == want
    assert all((r["path"] is None) == (r["depth"] < 0) and (r["path"] is None or len(r["path"]) == r["depth"] + 1) for r in got.values())
    pairs = {(r["ancestor_id"], r["id"], r["distance"]) for r in hierarchy.descendants(df).collect()}
    on_ring = {i for i in ids if want[i][1] < 0 and i in climb(clean, clean[i])}
    expected = {(at, i, k + 1) for i in parents if i not in on_ring for k, at in enumerate(climb(clean, clean[i], on_ring))}
    assert pairs == expected
    for root in (max(expected)[0], *sorted(on_ring)[:1])[:seed]:
        assert rows(hierarchy.below(hierarchy.current_nodes(df), root)) == sorted((i,) for a, i, _ in expected if a == root)


def test_hierarchy_versions_and_empty(spark):
    df = spark.createDataFrame([("1", "2", 0, "t", None, 0, None, T), ("1", None, 0, "t", None, 0, None, datetime(2025, 1, 1)), (None, "1", 0, "t", None, 0, None, T), ("1", "1", 0, "t", None, 0, None, None), ("s", "s", 0, "t", None, 0, None, T)], TREE)
    assert rows(hierarchy.full_hierarchy(df).select("id", "root_id", "depth")) == [("1", "1", 0), ("s", "s", -1)]
    assert rows(hierarchy.full_hierarchy(df.limit(0))) == []


def test_tree_operators(spark):
    df = spark.createDataFrame([("r", None, 0, "Root", None, 0, None, T), ("a", "r", 0, "A", None, 0, None, T), ("b", "r", 1, "a", None, 0, None, T), ("l", "a", 0, "", "http://x", None, None, T), ("e", "b", 0, "E", " ", 0, None, T)], TREE)
    assert rows(tree.empty_folders(df).select("id")) == [("b",), ("e",)]
    assert rows(tree.duplicate_folders(df)) == [("r", "a", 2, "a")]
    assert rows(tree.bookmarks(df).select("id", "title", F.array_join("path", "/"))) == [("l", "http://x", "Root/A")]
    assert tuple(tree.counts(df).first()) == (1, 4, 5)
    new, log = tree.move(df, spark.createDataFrame([("l", "b"), ("no", "b")], "id string, to_parent string"))
    assert rows(new.where("id = 'l'").select("parent_id")) == [("b",)] and rows(tree.undo(new, log).select("id", "parent_id")) == rows(df.select("id", "parent_id"))
    assert rows(tree.delete_subtree(df, "a").select("id")) == [("b",), ("e",), ("r",)]
    assert tree.ensure_folders(df, spark.createDataFrame([("r", "A"), ("r", "New"), ("r", "New")], "parent_id string, title string")).select("title").collect()[0][0] == "New"
    nested = spark.createDataFrame([('{"id":"0","children":[{"id":"1","title":"F","children":[{"id":"2","url":"u"}]},{"id":"3"}]}',), ("broken",)], "j string")
    assert rows(tree.from_json_tree(nested, "j").select("id", "parent_id", "idx")) == [("0", None, 0), ("1", "0", 0), ("2", "1", 0), ("3", "0", 1)]


# ---- duplicates
def test_exact_groups_and_chunks(spark):
    df = links(spark, [(1, "a", "https://example.com/x?utm_source=1", 5, "A/B"), (2, "b", "https://example.com/x", 9, "A"), (3, "c", "https://example.com/y", 1, None), (4, None, None, 1, None), (5, "d", " ", 1, None)])
    got = rows(dedupe.exact_groups(dedupe.valid_rows(df)).select("id", "role", "place"))
    assert got == [(1, "remove", 1), (2, "keep", 0)]
    assert rows(dedupe.rejected_rows(df).select("id")) == [(4,), (5,)]
    many = links(spark, [(i, "t", "https://example.com/x", i, None) for i in range(11)])
    sizes = dedupe.exact_groups(dedupe.valid_rows(many), dedupe.Options(max_group=5)).groupBy("chunk").count()
    assert rows(sizes) == [(0, 5), (1, 5)]


def test_similar_groups(spark):
    df = links(spark, [(1, "Machine learning basics course", "https://example.com/ml", 1, None), (2, "Machine learning basics course 2024", "https://example.com/ml-2", 2, None), (3, "Machine learning basics course", "https://other.org/ml", 3, None), (4, "Gardening", "https://example.com/g", 4, None)])
    got = dedupe.similar_groups(dedupe.valid_rows(df), dedupe.Options(threshold=0.8)).select("root", "id", "role", "score").collect()
    assert {(r["root"], r["id"], r["role"]) for r in got} == {(1, 1, "keep"), (1, 2, "remove")} and all(r["score"] >= 0.8 for r in got)


def test_scale_over_several_domains(spark):
    df = links(spark, [(i, f"Item number {i} of shelf {i % 7}", f"https://site{i % 3}.example.org/p/{i}", i, None) for i in range(300)])
    r = dedupe.statistics(df).first()
    assert r["scanned"] == 300 and r["skipped_buckets"] == 0 and r["exact_groups"] == 0


def test_connected(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    assert {r["id"]: r["root"] for r in dedupe.connected(e).collect()} == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


# ---- classes, plans, links, import, labels
def test_classifier(spark):
    df = links(spark, [(1, "x", "https://openai.com", 0, None), (2, "x", "https://gist.github.com/a", 0, None), (3, "x", "https://www.xiaoyuzhoufm.com/episode", 0, None), (4, "x", "https://nowhere.test", 0, None), (5, None, None, None, None), (6, "", "not a url", 0, None)])
    got = {r["id"]: r["category"] for r in classes.classify(df).collect()}
    assert got == {1: "ai", 2: "dev", 3: "audio", 4: "other", 5: "other", 6: "other"}


def test_plan(spark):
    df = links(spark, [(1, "a", "https://a.com/1", 0, None), (2, "a", "https://www.A.com/2", 0, ""), (3, "a", "https://a.com/3", 0, "Archive/a.com"), (4, "a", "https://b.com", 0, None), (5, "a", "https://a.com/5", 0, "Else")])
    p = planner.plan(df, "domain")
    assert {r["id"]: r["status"] for r in p.collect()} == {1: "movable", 2: "movable", 3: "filed", 4: "small", 5: "skipped"}
    assert rows(planner.folders(p)) == [("Archive", "Archive", 0), ("Archive/a.com", "a.com", 2)]
    after = spark.createDataFrame([(1, ["Archive", "a.com"]), (2, ["x"])], "id bigint, path array<string>")
    assert rows(planner.verify(p, after)) == [(2, "Archive/a.com", "x")]


def test_link_states(spark):
    df = links(spark, [(i, "", u, 0, None) for i, u in enumerate(["https://a.com/1", "https://a.com/2", "https://a.com/1#x", None, "chrome://x", "https://a.com/4"])])
    r = spark.createDataFrame([("https://a.com/1", 200, None, None, "https://a.com/1"), ("https://a.com/2", 405, 404, None, None)], linkcheck.RESPONSE)
    assert {x["id"]: x["status"] for x in linkcheck.check(df, r).collect()} == {0: "ok", 1: "broken", 2: "ok", 3: "empty", 4: "unsupported", 5: "timeout"}
    probed = linkcheck.probe(df, lambda norms: ((n, 200, None, None, n) for n in norms))
    assert probed.count() == 3 and linkcheck.summary(linkcheck.check(df, probed)).first()["ok"] == 4


def test_import_twice_creates_nothing(spark):
    lib = links(spark, [(1, "a", "https://a.com/", 0, None)])
    new = links(spark, [(2, "b", "https://b.com", 0, None), (3, "b", "https://b.com#x", 0, None), (4, "a", "https://a.com", 0, None), (5, "x", "nope nope", 0, None)])
    assert {r["id"]: r["action"] for r in merge.plan_import(new, lib).collect()} == {2: "created", 3: "skipped", 4: "skipped", 5: "failed"}
    both = merge.merged(new, lib)
    assert set(r["action"] for r in merge.plan_import(new, both).collect()) == {"skipped", "failed"}
    assert {r["id"]: r["action"] for r in merge.plan_import(new, lib, "overwrite").collect()}[4] == "replaced"


def test_labels(spark):
    df = spark.createDataFrame([(1, "t", "u"), (2, "t", "u")], "id bigint, title string, url string")
    answers = label_ops.ask(df.coalesce(1), lambda rs: '{"assignments":[{"id":"1","category":"dev","confidence":7,"tags":["a",""]},{"id":"2","category":"bad"},]}')
    got = label_ops.assignments(answers, ["dev"])
    local = spark.createDataFrame([(1, "ai", 0.5), (2, "ai", 0.5)], "id bigint, category string, confidence double")
    assert rows(label_ops.label(df, got, local)) == [("1", "dev", 1.0, "ai"), ("2", "ai", 0.5, "local")]
    assert label_ops.assignments(label_ops.ask(df, lambda rs: 1 / 0), ["dev"]).count() == 0


# ---- bookmark files
def test_netscape_round_trip(spark, tmp_path):
    recs = [(0, 'A & <b> "c" ©', "https://x/?a=1&b=2", [], 12.0, None), (1, "n", "https://y", ["F", "G"], None, "data:x"), (2, "m", "https://z", ["F"], None, None), (3, "r", "https://w", [], None, None)]
    df = spark.createDataFrame(recs, "ord bigint, title string, url string, path array<string>, add_date double, icon string")
    netscape.write(df, str(tmp_path / "out"))
    body = "\n".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert body.startswith("<!DOCTYPE") and sorted(netscape.parse(body)) == sorted(r[1:] for r in recs)


def test_netscape_tolerance(spark):
    assert netscape.parse(None) == [] and netscape.parse("<a href=x>open") == [("open", "x", [], None, None)]
    assert netscape.parse("<H3>lost</H3></DT><DL><A HREF='u'>t</A>")[0][2] == []
    assert netscape.parse('<H3>F</H3><DL><!-- <a href=no>x</a> --><A HREF="u>v" ADD_DATE=x>a\n b</A></DL><A HREF=w>t</A>') == [("a b", "u>v", ["F"], None, None), ("t", "w", [], None, None)]
    files = spark.createDataFrame([("f", "<a href=x>y</a>"), ("g", None)], "file string, content string")
    assert [(r["file"], r["url"]) for r in netscape.records(files).collect()] == [("f", "x")]
