import pytest
from pyspark.sql import functions as F

from linklake.operators import archive, dedupe, labels, linkcheck, snapshots, tree
from linklake.sources import portable

NODE = "id string, parent_id string, idx int, title string, url string"
LINK = "id bigint, title string, url string, date_added bigint, path string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def column(spark, f, xs):
    df = spark.createDataFrame(list(enumerate(xs)), "i int, x string")
    return [r[0] for r in df.select(f(F.col("x")), "i").orderBy("i").collect()]


def test_find_duplicates_by_flags(spark):
    data = [(1, "Old harbour museum guide", "https://oak.net/museum", 5, "A"), (2, "Old harbour museum guide", "https://oak.net/museum/", 9, "A/B"), (3, "Old harbour museum guides", "https://oak.net/museum?p=2", 1, None), (4, "Old harbour museum guide", "https://oak.net/museum?p=3", 1, None)]
    df = spark.createDataFrame(data, LINK)
    both, exact, similar = (dedupe.find_duplicates(df, dedupe.Options(threshold=0.6), *flags) for flags in ((True, True), (True, False), (False, True)))
    assert rows(exact.select("id", "role", "score")) == [(1, "keep", 1.0), (2, "remove", 1.0)]
    assert {r["kind"] for r in similar.collect()} == {"similar"} and rows(both.select("group_id", "id")) == rows(exact.union(similar).select("group_id", "id"))
    assert dedupe.by_size(both).first()["n"] == similar.count()
    with pytest.raises(ValueError):
        dedupe.find_duplicates(df, include_exact=False, include_similar=False)


def test_exact_chunks_of_crowded_addresses(spark):
    df = spark.createDataFrame([(i, "t", "https://oak.net/x", i, None) for i in range(7)] + [(9, "t", "https://oak.net/y", 1, None), (8, "t", "https://oak.net/y", 1, None)], LINK)
    got = rows(dedupe.exact_groups(dedupe.valid_rows(df), dedupe.Options(max_group=3)).select("norm", "chunk", "id"))
    assert got == [("https://oak.net/x", i // 3, i) for i in range(6)] + [("https://oak.net/y", 0, 8), ("https://oak.net/y", 0, 9)]


def test_run_moves_links_and_removes_emptied_folders(spark):
    nodes = spark.createDataFrame([("0", None, 0, "", None), ("1", "0", 0, "Bar", None), ("t", "1", 0, "Target", None), ("a", "1", 1, "A", None), ("b", "1", 2, "B", None), ("x", "a", 0, "x", "u"), ("y", "b", 0, "y", "u"), ("z", "b", 1, "z", "u"), ("w", "t", 0, "w", "u"), ("v", "1", 3, "v", "u")], NODE)
    moves = spark.createDataFrame([("x", "Target"), ("y", "New"), ("w", "Target"), ("gone", "New"), ("v", "New")], "id string, folder string")
    new, log, removed = archive.run(nodes, moves, "1")
    by = {r["id"]: r["parent_id"] for r in new.collect()}
    made = new.where("title = 'New'").first()["id"]
    assert by["x"] == "t" and by["y"] == by["v"] == made and by["w"] == "t" and by["z"] == "b" and by[made] == "1" and "a" not in by
    assert rows(log) == [("v", "1", 3), ("x", "a", 0), ("y", "b", 0)] and rows(removed) == [("a",)]
    assert rows(archive.retarget(moves, spark.createDataFrame([("y",)], "id string"), "Z").where("folder = 'Z'").select("id")) == [("y",)]


def test_trash_folder_is_kept_renamed_or_made(spark):
    nodes = spark.createDataFrame([("1", None, 0, "Bar", None), ("o", "1", 0, "Old bin", None), ("p", "1", 0, "Old bin", None)], NODE)
    once = tree.trash(nodes, "1", "Bin", ["Old bin"])
    assert rows(once.where("title = 'Bin'").select("id")) == [("o",)] and once.count() == 3
    assert tree.trash(once, "1", "Bin").count() == 3 and tree.trash(nodes, "1", "Bin").count() == 4


def test_trees_as_text_and_back(spark):
    nodes = spark.createDataFrame([("r", None, 0, "R", None), ("b", "r", 2, 'B "<', None), ("a", "r", 1, None, "u?x&y"), ("c", "b", None, "C", "v"), ("k", "l", 0, "", None), ("l", "k", 0, "", None), ("e", " ", 0, "E", None)], NODE)
    placed = portable.placed(nodes)
    text_ = portable.gathered(portable.json_lines(placed), "")
    back = tree.from_json_tree(text_, "content")
    assert rows(back.select("id", "parent_id", "idx")) == [("a", "r", 0), ("b", "r", 1), ("c", "b", 0), ("e", None, 0), ("r", None, 0)]
    html = {r["root_id"]: r["content"] for r in portable.gathered(portable.html_lines(placed.withColumn("date_added", F.lit(None).cast("bigint")))).collect()}
    assert html["r"].splitlines()[2] == '        <DT><A HREF="u?x&amp;y" ADD_DATE=""></A>' and html["r"].count("<DL><p>") == html["r"].count("</DL><p>") == 2
    new = tree.inserted(nodes, back.where("order_key[0] = 0 and size(order_key) > 0").where("id in ('r', 'a', 'b', 'c')"), "e")
    assert new.where("id like 'i0%'").count() == 4 and rows(new.where("id = 'i0.1.0'").select("parent_id")) == [("i0.1",)]


def test_import_forms(spark):
    ids = lambda a: F.transform(a, lambda v: F.try_variant_get(v, "$.id", "string"))
    texts = ['[{"id":"1"},{"id":"2"}]', '[{"id":"f","children":[{"id":"3"}]}]', '{"id":"4"}', "oops", None]
    assert column(spark, lambda c: ids(portable.import_nodes(c)), texts) == [["1", "2"], ["3"], ["4"], None, None]
    texts = ['[{"id":"1"}]', '{"tabs":[{"id":"2"}]}', '{"windows":[{"tabs":[{"id":"3"}]},{},{"tabs":[{"id":"4"}]}]}', '{"x":1}', "oops", None]
    assert column(spark, lambda c: ids(portable.import_tabs(c)), texts) == [["1"], ["2"], ["3", "4"], [], [], []]
    assert column(spark, portable.sniffed, [" <html>", "{}", None]) == ["html", "json", "json"]


def test_snapshot_upkeep(spark):
    n = spark.createDataFrame([("s", "1", None, 0, "Bar", None, None), ("s", "7", "1", 0, "t", "u", None), ("q", "9", "x", 0, "t", "u", None)], "snapshot_id string, id string, parent_id string, idx int, title string, url string, loaded_at timestamp")
    new, n_ = snapshots.restore_tree(n, "s")
    assert rows(new.select("id", "parent_id")) == [("1", None), ("r7", "1")] and tuple(n_.first()) == (1, 2)
    assert snapshots.deleted(n, ["s"]).count() == 1 and snapshots.cleared(n).count() == 0 and snapshots.get(n, "none").count() == 0


def test_attempts():
    waits, calls = [], []

    def failing(status, until):
        def call():
            calls.append(1)
            if len(calls) < until:
                raise labels.ProviderError("no", status)
            return "yes"

        calls.clear()
        waits.clear()
        return call

    assert labels.attempted(failing(503, 3), 3, waits.append) == ("yes", None, 3) and waits == [0.4, 0.8]
    assert labels.attempted(failing(401, 3), 3, waits.append) == (None, "ProviderError: no", 1) and not waits
    assert labels.attempted(failing(None, 9), 2, waits.append) == (None, "ProviderError: no", 2)


def test_answers_and_names(spark):
    raw = ['{"choices":[{"message":{"content":"a"}}]}', '{"choices":[{"message":{"content":["b",{"text":"c"},{"n":1}]}}]}', '{"choices":[{"text":"d"}]}', '{"content":"e"}', '{"text":"f"}', "[]", "oops", None]
    assert column(spark, labels.answer_text, raw) == ["a", "bc", "d", "e", "f", "", "", ""]
    assert column(spark, labels.model_names, ['["m"]', '{"data":[{"id":"n"},{"id":""}]}', '{"models":[{"name":"o"}]}', "oops"]) == [["m"], ["n"], ["o"], []]


def test_rule_class_and_reports(spark):
    rules = [("one", ["oak.net"], ["alpha"], []), ("two", [], ["beta"], ["gamma"])]
    df = spark.createDataFrame([(1, None, "https://a.oak.net/x"), (2, "beta gamma", "http://z.org/beta"), (3, "beta", "http://z.org"), (4, "x", "http://oak.net/file.PDF"), (5, None, None)], "id int, title string, url string")
    assert [r[0] for r in df.orderBy("id").select(archive.rule_class(F.col("title"), F.col("url"), {"paper": ["pdf"]}, rules)).collect()] == ["one", "two", "other", "paper", "other"]
    checked = spark.createDataFrame([(1, "ok", 200), (2, "blocked", 403), (3, "empty", None), (4, "broken", 404)], "id int, status string, http_status int")
    assert rows(linkcheck.reported(checked, ["status"]).select("id")) == [(2,), (4,)] and linkcheck.by_label(linkcheck.reported(checked)).count() == 3


def test_clean_deletes_written_tables(spark):
    import os

    from linklake import runtime

    ws = runtime.Workspace(spark, "clean")
    df, n = ws.put_counted(spark.range(5), rows=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    folder = ws.base.removeprefix("file://")
    assert n == {"rows": 5, "even": 3} and df.count() == 5 and os.path.isdir(folder)
    runtime.clean(spark)
    assert not os.path.exists(folder)
