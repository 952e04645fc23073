"""Explainable classification of links by weighted signals from a taxonomy.

The taxonomy is a parameter: rows (category, kind, term) with kind host, title, url, path or phrase, categories in order.
Every signal is an equi-join of exploded row terms with a small dimension (size-checked broadcast), so a larger taxonomy
only changes the dimension. ``TAXONOMY`` is a short built-in excerpt; pass a full one in the same form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linklake.functions import dates, text, urls
from linklake.runtime import maybe_broadcast

# Weights and caps of the signals; least score; category without a signal.
WEIGHTS = {"host": (10, 10), "base": (6, 6), "path": (3, 6), "title": (2, 6), "phrase": (2, 4), "url": (1, 3)}
MIN_SCORE, OTHER = 2, "other"

# An excerpt of the taxonomy: category -> hosts, url words, title words, path hints.
TAXONOMY = {
    "ai": ("openai.com huggingface.co claude.ai", "openai chatgpt llm", "gpt copilot 人工智能", "/gpt/ /llm/ /ai/"),
    "dev": ("github.com gitlab.com stackoverflow.com npmjs.com", "github docker api sdk", "github docker api 代码 编程", "/pull/ /issues/ /commit/ /api/"),
    "docs": ("readthedocs.io wikipedia.org docs.rs", "gitbook wiki", "handbook manual reference wiki 文档", "/docs/ /wiki/ /guide/"),
    "design": ("dribbble.com figma.com", "figma sketch", "design figma 设计", "/design/"),
    "video": ("youtube.com vimeo.com bilibili.com", "youtube netflix", "video watch live 视频", "/watch /video/ /live/"),
    "audio": ("spotify.com xiaoyuzhoufm.com", "podcast fm", "podcast music episode 音乐", "/podcast/ /music/"),
    "news": ("bbc.co.uk nytimes.com", "reuters guardian", "news headline report 新闻", "/news/ /article/ /story/"),
    "social": ("twitter.com reddit.com zhihu.com", "reddit tweet", "thread post 社交", "/status/ /user/"),
    "edu": ("coursera.org udemy.com", "course lecture", "course lesson learn 课程", "/course/ /lesson/"),
    "shopping": ("amazon.com ebay.com", "amazon ebay", "shop deal 购物", "/product/ /item/"),
    "office": ("docs.google.com notion.so", "notion spreadsheet", "sheet office 表格", "/docs/ /sheets/"),
    "game": ("steampowered.com", "steam", "game 游戏", "/game/ /play/"),
    "finance": ("paypal.com", "bank stock fund", "bank stock 银行", "/finance/ /stock/"),
    "travel": ("booking.com", "booking", "travel hotel 旅游", "/hotel/ /travel/"),
}


def taxonomy_rows(taxonomy: dict = TAXONOMY) -> list[tuple[int, str, str, str]]:
    """(place, category, kind, term); a host or base domain listed twice belongs to the first category."""
    out, hosts = [], set()
    for place, (category, (h, u, t, p)) in enumerate(taxonomy.items()):
        for host in h.lower().split():
            if host not in hosts:
                hosts.add(host)
                out.append((place, category, "host", host))
        for kind, terms in (("url", u), ("title", t), ("path", p)):
            out += [(place, category, kind, x) for x in dict.fromkeys(terms.lower().split())]
        out += [(place, category, "phrase", x) for x in dict.fromkeys(t.lower().split()) if len(x) > 2 and any("一" <= c <= "鿿" for c in x) or "-" in x]
    return out


def dimension(spark: SparkSession, taxonomy: dict = TAXONOMY) -> DataFrame:
    return spark.createDataFrame(taxonomy_rows(taxonomy), "place int, category string, kind string, term string")


def _of(dim: DataFrame, kind: str) -> DataFrame:
    return maybe_broadcast(dim.where(F.col("kind") == kind).select("place", "category", "term"))


def host_match(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """(id, place, category): the longest listed suffix (two labels or more) of each host."""
    labels = F.filter(F.split("host", r"\."), lambda p: p != "")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size("labels") - 1, F.lit(1))), lambda i: F.struct(i.alias("rank"), F.array_join(F.slice("labels", i, F.size("labels")), ".").alias("term")))
    terms = rows.where("host <> ''").withColumn("labels", labels).where("size(labels) > 0").select("id", F.inline(ends))
    hit = terms.join(_of(dim, "host"), "term").groupBy("id").agg(F.min(F.struct("rank", "place", "category")).alias("m"))
    return hit.select("id", "m.place", "m.category")


def signals(df: DataFrame, dim: DataFrame) -> DataFrame:
    """(id, place, category, signal, points), points capped for each signal."""
    rows = df.where("id is not null").select(
        "id", F.left(F.coalesce("title", F.lit("")), F.lit(500)).alias("title"), F.left(F.lower(F.coalesce("url", F.lit(""))), F.lit(1500)).alias("low"),
        urls.norm_host(urls.host(F.col("url"))).alias("host"), F.lower(F.array_join(dates.path_array(F.col("path")), "/")).alias("folder"),
        F.lower(F.regexp_extract(urls.absolute(F.col("url")), r"^(?i:https?)://[^/?#]*([^?#]*)", 1)).alias("pathname"),
    )
    host = host_match(rows, dim)
    base_dim = dim.where("kind = 'host'").select("place", "category", urls.base_domain_of(F.col("term")).alias("term")).groupBy("term").agg(F.min(F.struct("place", "category")).alias("m")).select("term", "m.*")
    base = rows.join(host.select("id"), "id", "left_anti").where("host <> ''").select("id", urls.base_domain_of(F.col("host")).alias("term")).join(maybe_broadcast(base_dim), "term")

    def capped(d: DataFrame, signal: str) -> DataFrame:
        weight, cap = WEIGHTS[signal]
        return d.groupBy("id", "place", "category").agg(F.least(F.count("*") * weight, F.lit(cap)).alias("points")).withColumn("signal", F.lit(signal))

    tokens = lambda c: rows.select("id", F.explode(text.title_tokens(F.col(c))).alias("term"))
    # hints and phrases are containments; the dimension is small, so every row tests it in one expression
    hits = lambda kind, hay: _contained(rows, dim, kind, hay)
    path = capped(hits("path", F.concat(F.coalesce("pathname", F.lit("")), F.lit(" "), F.col("folder"))), "path")
    title = capped(tokens("title").join(_of(dim, "title"), "term"), "title")
    phrase = capped(hits("phrase", F.lower("title")), "phrase").join(host.select("id", "category", F.lit(True).alias("is_host")), ["id", "category"], "left").where("is_host is null").drop("is_host")
    url = capped(tokens("low").join(_of(dim, "url"), "term"), "url").join(host.select("id", F.col("category").alias("won")), "id", "left")
    url = url.withColumn("points", F.when(F.col("won") == F.col("category"), F.least("points", F.lit(2))).otherwise(F.col("points"))).drop("won")
    parts = [host.withColumn("points", F.lit(10).cast("bigint")).withColumn("signal", F.lit("host")), base.withColumn("points", F.lit(6).cast("bigint")).withColumn("signal", F.lit("base")), path, title, phrase, url]
    return reduce(DataFrame.unionByName, [p.select("id", "place", "category", "signal", "points") for p in parts])


def _contained(rows: DataFrame, dim: DataFrame, kind: str, hay: Column) -> DataFrame:
    """(id, place, category), one row for each term of ``kind`` that ``hay`` contains. The terms travel as a literal
    array: the taxonomy is a parameter of bounded size."""
    terms = dim.where(F.col("kind") == kind).select("term", "place", "category").limit(10_001).collect()
    if len(terms) > 10_000:
        raise ValueError("a taxonomy holds at most 10,000 hints and phrases")
    if not terms:
        return rows.select("id", F.lit(0).alias("place"), F.lit("").alias("category")).where(F.lit(False))
    all_ = F.array(*[F.struct(F.lit(t["term"]).alias("term"), F.lit(t["place"]).alias("place"), F.lit(t["category"]).alias("category")) for t in terms])
    found = rows.select("id", F.inline(F.filter(F.transform(all_, lambda t: t), lambda t: F.contains(hay, t["term"]))))
    return found.select("id", "place", "category")


def classify(df: DataFrame, taxonomy: dict = TAXONOMY, min_score: int = MIN_SCORE) -> DataFrame:
    """(id, category, confidence, reasons): the category of the most points, the first in order at a tie; ``other``
    below ``min_score``. Null titles, urls and paths give no signal. Rows with a null id are left out."""
    s = signals(df, dimension(df.sparkSession, taxonomy))
    by = s.groupBy("id", "place", "category").agg(F.sum("points").alias("score"), F.array_sort(F.collect_list(F.format_string("%s (+%d)", "signal", "points"))).alias("reasons"))
    best = by.groupBy("id").agg(F.max(F.struct("score", (-F.col("place")).alias("p"), "category", "reasons")).alias("b"))
    j = df.where("id is not null").select("id").join(best, "id", "left")
    ok = F.col("b.score") >= min_score
    return j.select("id", F.when(ok, F.col("b.category")).otherwise(OTHER).alias("category"), F.when(ok, dates.confidence(F.col("b.score"))).when(F.col("b.score") > 0, 0.25).otherwise(0.15).alias("confidence"), F.array_join(F.coalesce("b.reasons", F.array(F.lit("no signal"))), "; ").alias("reasons"))


def summary(classified: DataFrame) -> DataFrame:
    """(category, n, avg_confidence) of the categories in use."""
    return classified.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))


def suggest_rules(df: DataFrame, classified: DataFrame, min_count: int = 3, min_ratio: float = 0.6) -> DataFrame:
    """(host, category, n, ratio, confidence): hosts of which ``min_ratio`` agree on a category other than ``other``."""
    keyed = df.select("id", urls.norm_host(urls.base_domain(F.col("url"))).alias("host")).where("host <> ''").join(classified, "id")
    votes = keyed.groupBy("host", "category").agg(F.count("*").alias("k"), F.sum("confidence").alias("c"))
    top = votes.groupBy("host").agg(F.sum("k").alias("n"), F.max(F.struct("k", "category", "c")).alias("t")).where((F.col("n") >= min_count) & (F.col("t.category") != OTHER) & (F.col("t.k") >= min_ratio * F.col("n")))
    return top.select("host", "t.category", "n", F.round(F.col("t.k") / F.col("n"), 2).alias("ratio"), F.round(F.col("t.c") / F.col("t.k"), 2).alias("confidence"))


def first_rule(rules: list[tuple[str | None, str]], hay: Column, default: str, regex: bool = False) -> Column:
    """Folder of the first rule whose pattern occurs in ``hay`` (a null pattern always does); ordered first match."""
    out = None
    for pattern, folder in rules:
        hit = F.lit(True) if pattern is None else hay.rlike(pattern) if regex else F.contains(F.lower(hay), F.lit(pattern.lower()))
        out = F.when(hit, folder) if out is None else out.when(hit, folder)
    return F.lit(default) if out is None else out.otherwise(default)
