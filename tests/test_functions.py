import pytest
from pyspark.sql import functions as F

from linklake.functions import dates, text, urls


def values(spark, f, xs, kind="string"):
    df = spark.createDataFrame(list(enumerate(xs)), f"i int, x {kind}")
    return [r[0] for r in df.select(f(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_normalize(spark):
    cases = {
        "HTTPS://Shop.Oak.NET:443/Lamp//?gclid=7&size=9&colour=red#top": "https://shop.oak.net/Lamp?colour=red&size=9",
        "http://oak.net:443/": "http://oak.net:443/",
        "http://oak.net?utm_campaign=May": "http://oak.net/",
        "https://oak.net/q?B=1&a=2&b=0": "https://oak.net/q?a=2&b=1&b=0",
        "https://oak.net/q?x=1+2&y=%zz&Empty=": "https://oak.net/q?empty&x=1 2&y=%zz",
        "Oak.net/Path/": "https://oak.net/Path",
        "about:Blank": "about:blank",
        "\t": "",
        None: "",
    }
    assert values(spark, urls.normalize, list(cases)) == list(cases.values())
    once = [v for v in cases.values() if v.startswith("http") and " " not in v and "%" not in v]
    assert values(spark, urls.normalize, once) == once


def test_domains(spark):
    cases = {"https://a.b.oak.net:8080/x": "oak.net", "shop.oak.co.uk": "oak.co.uk", "http://oak.com.cn": "oak.com.cn", "http://192.168.7.1/": "192.168.7.1", "intranet": "intranet", None: None, "two words": ""}
    assert values(spark, urls.base_domain, list(cases)) == list(cases.values())
    assert values(spark, urls.hostname, ["https://www.Oak.net./", "ftp://oak.net", "https://me:pw@oak.org:8080/x"]) == ["oak.net", "", "oak.org"]


def test_classify_and_api_base(spark):
    assert [r["kind"] for r in values(spark, urls.classify, ["", None, "http://", "http://a.b", "chrome://x"])] == ["empty", "empty", "invalid", "http", "other"]
    assert values(spark, urls.api_base, ["https://a/b/", "https://a/V1", " ", None]) == ["https://a/b/v1", "https://a/v1", None, None]


def test_tokens(spark):
    got = values(spark, text.title_tokens, ["Oak chairs and OAK tables: 木椅", None, "!", "node.js-- x c# 1"])
    assert [sorted(t) for t in got] == [["chairs", "oak", "tables", "木椅"], [], [], ["c#", "node.js"]]


def test_similarity(spark):
    df = spark.createDataFrame([("night", "nacht"), ("aaa", "aa"), ("", ""), ("a", "A"), (None, "x"), ("hello world", "HELLO  world")], "a string, b string")
    got = [r[0] for r in df.select(F.round(text.dice(F.col("a"), F.col("b")), 4)).collect()]
    assert got == [0.25, 0.6667, 0.0, 1.0, 0.0, 1.0]


def test_hash(spark):
    assert values(spark, text.short_hash, ["hello", "", None]) == ["4f9f2cab", "811c9dc5", "811c9dc5"]


@pytest.mark.parametrize(("answer", "want"), [
    ("Sure:\n```\n[{'id': 'k'},]\n```", "k"), ("{list: 3, id: 'k',}", None), ("[{id: 'it\\'s'}]", "it's"), ("[{'id': 'a \"b\" c'}]", 'a "b" c'), ('[{"id": "x: \'y\', z"}]', "x: 'y', z"), ("[{id: \"null, ]\", n: null}]", "null, ]"),
])
def test_json_repair(spark, answer, want):
    assert values(spark, lambda c: F.try_variant_get(text.parsed_json(c), "$[0].id", "string"), [answer]) == [want]
    assert values(spark, text.parsed_json, ["no json", None]) == [None, None]


def test_folder_names_and_markup(spark):
    assert values(spark, text.safe_folder, ['a/b:c*  d', None, "  ", "x" * 90]) == ["abc d", "ungrouped", "ungrouped", "x" * 80]
    assert values(spark, text.escape_html, ['<a href="x">&', None]) == ["&lt;a href=&quot;x&quot;&gt;&amp;", None]
    assert values(spark, lambda c: text.highlight(c, "a.b"), ["xA.bx acb"]) == ["x<em>A.b</em>x acb"]


def test_dates(spark):
    df = spark.createDataFrame([(1600000000000, 1), (1600000000, 1), (None, 1600000000000), (None, 5), (0, 1)], "v bigint, i bigint")
    got = [r[0] for r in df.select(F.array_join(dates.date_segments(dates.added_at(F.col("v"), F.col("i")), True), "/")).collect()]
    assert got == ["2020/2020-09", "2020/2020-09", "2020/2020-09", "unknown-date", "1970/1970-01"]
    assert values(spark, lambda c: dates.year_bucket(c, 2025), [None, 0, 1740000000000, 1710000000000, 1400000000000], "bigint") == ["unknown", "unknown", "this year", "last year", "2014"]
    assert values(spark, dates.clamp01, [None, float("nan"), -1.0, 2.0, 0.4], "double") == [0.5, 0.5, 0.0, 1.0, 0.4]
