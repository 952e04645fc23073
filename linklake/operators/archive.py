"""Filing links into folders: further classifiers, groups as they are shown, targets, and running a plan on a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklake.functions import dates, text, urls
from linklake.operators import classify, tree
from linklake.runtime import maybe_broadcast

# Families of hosts and file endings, first match first, with their labels.
TYPE_PATTERNS = [
    ("开发", r"github\.com|gitlab|stackoverflow|gitee|npmjs|mdn|w3schools|codepen|dev\.to|csdn|juejin|runoob"),
    ("视频", "youtube|bilibili|vimeo|twitch|douyin|iqiyi|youku|netflix"),
    ("社交", r"zhihu|weibo|twitter|x\.com|douban|reddit|v2ex|hupu|tieba"),
    ("文档", r"medium|jianshu|sspai|hexo|notion|yuque|docs\.|developer\.|wikipedia|readthedocs|gitbook"),
    ("新闻", r"sina|163\.com|sohu|thepaper|qq\.com|toutiao|nytimes|bbc|news"),
    ("购物", r"taobao|jd\.com|tmall|amazon|smzdm|pinduoduo"),
]
FILE_PATTERN, FILE_LABEL, OTHER_LABEL = r"\.(pdf|doc|docx|ppt|pptx|xls|xlsx|zip|rar|dmg|exe|apk)(\?|#|$)", "文档", "其他"
# Confidence of a host rule; points of a host, a title, an address and a path hit; hits that count; least score.
CUSTOM_CONFIDENCE = 0.97
HOST_POINTS, TITLE_POINTS, URL_POINTS, PATH_POINTS, MOST_HITS, MORE_THAN = 100, 10, 5, 2, 5, 15


def type_label(url: Column) -> Column:
    """One of seven labels by the family of the base domain, then by the file ending."""

    def of(host: Column) -> Column:
        out = None
        for label, pattern in TYPE_PATTERNS:
            out = F.when(host.rlike(pattern), label) if out is None else out.when(host.rlike(pattern), label)
        return out.when(F.lower(url).rlike(FILE_PATTERN), FILE_LABEL).otherwise(OTHER_LABEL)

    return urls.let(F.coalesce(urls.base_domain(url), F.lit("")), of)


def rule_class(title: Column, url: Column, endings: dict[str, list[str]], rules: list[tuple[str, list[str], list[str], list[str]]], other: str = "other") -> Column:
    """The category of a file ending, else of the rule (category, hosts, words, title words) with the most points: a host
    and its subdomains, words in title, address and path, at most five of each. The first rule wins a tie; without a host
    a rule needs more than 15 points. Null counts as ''. All of it is one expression."""
    low, name = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    host = urls.norm_host(urls.host(url))
    path = F.lower(F.coalesce(F.regexp_extract(url, r"^(?i:https?)://[^/?#]*([^?#]*)", 1), F.lit("")))
    hits = lambda words, hay: F.least(sum((F.contains(hay, F.lit(w)).cast("int") for w in words), F.lit(0)), F.lit(MOST_HITS)) if words else F.lit(0)

    def pick(x: Column) -> Column:
        scores = []
        for place, (category, hosts, words, titles) in enumerate(rules):
            at_home = F.lit(False)
            for h in hosts:
                at_home = at_home | (x["host"] == h) | x["host"].endswith(f".{h}")
            points = TITLE_POINTS * hits(titles or words, x["name"]) + URL_POINTS * hits(words, x["low"]) + PATH_POINTS * hits(words, x["path"])
            score = points + F.when(at_home, HOST_POINTS).otherwise(0)
            scores.append(F.struct(F.when(score > MORE_THAN, score).otherwise(0).alias("score"), F.lit(-place).alias("p"), F.lit(category).alias("category")))
        best = F.array_max(F.array(*scores))
        chosen = urls.let(best, lambda b: F.when(b["score"] > 0, b["category"]).otherwise(other))
        ending = F.regexp_extract(x["path"], r"\.([a-z0-9]{1,8})\z", 1)
        out = None
        for category, names in endings.items():
            out = F.when(ending.isin(names), category) if out is None else out.when(ending.isin(names), category)
        return chosen if out is None else out.otherwise(chosen)

    return urls.let(F.struct(low.alias("low"), name.alias("name"), F.coalesce(host, F.lit("")).alias("host"), path.alias("path")), pick)


def local_class(classified: DataFrame, rows: DataFrame, labels: dict[str, str], fallback: Column, other: str = classify.OTHER) -> DataFrame:
    """(id, label): the label of a row's category, and ``fallback`` (an expression over ``rows``) where it has none."""
    j = rows.select("id", fallback.alias("_f")).join(classified.select("id", "category"), "id", "left")
    return j.select("id", F.when(F.coalesce("category", F.lit(other)) == other, F.col("_f")).otherwise(labelled(F.col("category"), labels)).alias("label"))


def labelled(category: Column, labels: dict[str, str], default: str | None = None) -> Column:
    """Label of a category; the category itself (or ``default``) where there is none."""
    if not labels:
        return category if default is None else F.lit(default)
    out = None
    for k, v in labels.items():
        out = F.when(category == k, v) if out is None else out.when(category == k, v)
    return out.otherwise(category if default is None else F.lit(default))


def full_label(icon: Column, zh: Column, en: Column) -> Column:
    """``icon zh（en）``, one name where both are the same, without the parts that are null or blank."""
    both = F.when(F.coalesce(zh, F.lit("")) == "", en).when((F.coalesce(en, F.lit("")) == "") | (zh == en), zh).otherwise(F.concat(zh, F.lit("（"), en, F.lit("）")))
    return F.trim(F.concat_ws(" ", icon, both))


def custom_classes(rows: DataFrame, rules: DataFrame, categories: list[str]) -> DataFrame:
    """(id, category, confidence) by host rules (host, category): the longest listed suffix of the host. Rules without a
    host, of an unknown category or of ``other`` don't count; a host given twice belongs to its greatest category."""
    ok = rules.select(urls.norm_host(F.col("host")).alias("term"), F.lower("category").alias("category")).where(F.col("category").isin(categories) & (F.col("category") != classify.OTHER) & (F.col("term") != ""))
    dim = ok.groupBy("term").agg(F.max("category").alias("category")).select(F.lit(0).alias("place"), "category", F.lit("host").alias("kind"), "term")
    hosts = rows.where("id is not null").select("id", urls.norm_host(urls.host(F.col("url"))).alias("host"))
    return classify.host_match(hosts, dim).select("id", "category", F.lit(CUSTOM_CONFIDENCE).alias("confidence"))


def with_custom(classified: DataFrame, custom: DataFrame) -> DataFrame:
    """``classified`` (id, category, confidence) with the classes of host rules on top."""
    c = custom.select("id", F.col("category").alias("cc"), F.col("confidence").alias("cf"))
    return classified.join(c, "id", "left").select("id", F.coalesce("cc", "category").alias("category"), F.coalesce("cf", "confidence").alias("confidence"))


def host_classes(rows: DataFrame, classified: DataFrame) -> DataFrame:
    """(id, category): the class of a host's first row (smallest id) for all its rows; rows without a host go by their
    address. An aggregate and a join back, so a host with very many rows is a skewed key of one side only."""
    keyed = rows.where("id is not null").select("id", F.coalesce(F.nullif(urls.hostname(F.col("url")), F.lit("")), "url", F.lit("")).alias("host"))
    first = keyed.join(classified.select("id", "category"), "id").groupBy("host").agg(F.min(F.struct("id", "category")).alias("f"))
    return keyed.join(first, "host").select("id", "f.category")


def custom_key(rules: list[tuple[str, str]], domain: Column, kind: Column) -> Column:
    """Folder of the first rule (key, folder) whose key is the domain or the kind, or occurs in the domain; else null."""
    out = None
    for key, folder in rules:
        hit = (domain == key) | (kind == key) | F.contains(domain, F.lit(key))
        out = F.when(hit, folder) if out is None else out.when(hit, folder)
    return F.lit(None).cast("string") if out is None else out


def preview(rows: DataFrame, key: Column, preferred: list[str] | None = None, min_size: int = 1, other: str = "other") -> DataFrame:
    """(name, n, id): every row with its group and the group's size; names outside ``preferred`` go to ``other``, groups
    under ``min_size`` are left out. One aggregate and a many-to-one join back."""
    k = F.coalesce(key, F.lit(other))
    if preferred:
        k = F.when(k.isin(preferred), k).otherwise(other)
    named = rows.select("id", k.alias("name"))
    sizes = named.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    return named.join(sizes, "name").select("name", "n", "id")


def visible(groups: DataFrame, selected: list[str] = [], only: str | None = None, other: str = "other") -> DataFrame:  # noqa: B006
    """Rows (name, ...) of the selected groups and always of ``other``; without a selection those of the group ``only``,
    if one is named."""
    if selected:
        return groups.where(F.col("name").isin([*selected, other]))
    return groups.where(F.col("name") == only) if only else groups


def retarget(moves: DataFrame, ids: DataFrame, target: str) -> DataFrame:
    """``moves`` (id, folder) with the folder of the given ids replaced."""
    chosen = ids.select("id", F.lit(target).alias("_t")).distinct()
    return moves.join(chosen, "id", "left").withColumn("folder", F.coalesce("_t", "folder")).drop("_t")


def run(nodes: DataFrame, moves: DataFrame, root_id: str, builtin: list[str] = ["0", "1", "2", "3"]) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B006
    """(new version, undo log, removed folders): moves (id, folder) into folders below ``root_id``, which are made where
    they are missing; what is there already stays. Folders that lost a link and have nothing left are removed, but for
    ``builtin`` ones and their children. ``nodes`` has unique ids, parent_id, title, url, idx."""
    known = nodes.select("id", F.col("parent_id").alias("from_parent"), F.col("idx").alias("from_idx"))
    wanted = moves.join(known, "id").select("id", "from_parent", "from_idx", "folder")
    made = tree.ensure_folders(nodes, wanted.select(F.lit(root_id).alias("parent_id"), F.col("folder").alias("title")))
    have = nodes.where(tree.is_folder() & (F.col("parent_id") == root_id)).groupBy("title").agg(F.min("id").alias("to"))
    targets = have.union(made.select("title", F.col("id").alias("to")))
    todo = wanted.join(maybe_broadcast(targets.select(F.col("title").alias("folder"), "to")), "folder").where(~F.col("to").eqNullSafe(F.col("from_parent")))
    moved = nodes.join(todo.select("id", "to"), "id", "left").withColumn("parent_id", F.coalesce("to", "parent_id")).drop("to")
    new = moved.unionByName(made, allowMissingColumns=True)
    sources = todo.select(F.col("from_parent").alias("id")).where("id is not null").distinct()
    in_use = new.select(F.col("parent_id").alias("id")).where("id is not null").distinct()
    empty = sources.join(in_use, "id", "left_anti").join(nodes.where(~F.col("id").isin(builtin) & ~F.coalesce(F.col("parent_id") == builtin[0], F.lit(False))).select("id"), "id", "left_semi")
    return new.join(empty, "id", "left_anti"), todo.select("id", F.col("from_parent").alias("parent_id"), F.col("from_idx").alias("idx")), empty


def legacy_scores(title_a: Column, title_b: Column, url_a: Column, url_b: Column) -> Column:
    """struct(title, path, host) of similarities of two links; path compares hosts with paths."""
    base = lambda u: urls.legacy_base_domain(urls.legacy_hostname(u))
    return F.struct(
        text.legacy_dice(title_a, title_b).alias("title"), text.legacy_dice(urls.legacy_base(url_a), urls.legacy_base(url_b)).alias("path"),
        text.host_similarity(urls.legacy_hostname(url_a), urls.legacy_hostname(url_b), base(url_a), base(url_b)).alias("host"),
    )
