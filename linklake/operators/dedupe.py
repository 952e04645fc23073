"""Exact and similar duplicate groups of a link table.

Exact: same canonical address. Similar: blocks by registrable domain, candidates by shared title tokens, scored pairs,
connected components. The caps on buckets, candidates and group sizes are part of the results and are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linklake.functions import dates, text, urls
from linklake.operators.ordering import number_in_group
from linklake.runtime import Workspace


@dataclass(frozen=True)
class Options:
    threshold: float = 0.82
    max_candidates: int = 40
    max_bucket: int = 2000
    max_group: int = 200


def valid_rows(df: DataFrame) -> DataFrame:
    """id, title, url, date_added, depth, norm and domain of the rows with an id and a non-blank url."""
    ok = df.where("id is not null").where(F.coalesce(urls.trimmed(F.col("url")) != "", F.lit(False)))
    domain = urls.let(urls.base_domain(F.col("url")), lambda d: F.when(d == "", F.lit("__unknown")).otherwise(d))
    return ok.select("id", "title", "url", "date_added", F.size(dates.path_array(F.col("path"))).alias("depth"), urls.normalize(F.col("url")).alias("norm"), domain.alias("domain"))


def rejected_rows(df: DataFrame) -> DataFrame:
    """id and reason of the rows that ``valid_rows`` leaves out."""
    bad = F.col("id").isNull() | ~F.coalesce(urls.trimmed(F.col("url")) != "", F.lit(False))
    return df.where(bad).select("id", F.lit("malformed bookmark").alias("reason"))


def _keep_order() -> list:
    """Shallowest, oldest (null dates last), shortest address, smallest id as text."""
    return [F.col("depth"), F.col("date_added").asc_nulls_last(), F.length("url"), F.col("id").cast("string")]


def roles(members: DataFrame, group: list[str]) -> DataFrame:
    """``members`` with role (keep or remove) and place: 0 for the kept row, then by date, newest first. Groups must be
    bounded, as the chunks of ``exact_groups`` and the pieces of ``similar_groups`` are."""
    kept = members.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*_keep_order())))
    rest = W.partitionBy(*group).orderBy(F.when(F.col("_r") == 1, 0).otherwise(1), F.col("date_added").desc_nulls_last(), "_r")
    return kept.withColumn("place", F.row_number().over(rest) - 1).withColumn("role", F.when(F.col("_r") == 1, "keep").otherwise("remove")).drop("_r")


def exact_groups(rows: DataFrame, opts: Options = Options()) -> DataFrame:  # noqa: B008
    """(norm, chunk, group_id, id, role, place): rows of one canonical address, in chunks of ``max_group`` in id order.
    Single rows, and a chunk left with one row, are no group."""
    ws = Workspace(rows.sparkSession, "exact")
    several = ws.put(rows.groupBy("norm").agg(F.count("*").alias("n")).where("n > 1"))
    # a crowded address is a skewed key of the large side only
    members = rows.join(several, "norm")
    one = members.where(F.col("n") <= opts.max_group).withColumn("chunk", F.lit(0).cast("bigint"))
    if several.where(F.col("n") > opts.max_group).isEmpty():
        sized = one
    else:  # only crowded addresses need numbers, which take range partitions
        crowded = number_in_group(members.where(F.col("n") > opts.max_group), ["norm"], ["id"]).withColumn("chunk", F.floor(F.col("place") / opts.max_group)).drop("place")
        sized = one.unionByName(crowded).where(~((F.col("n") % opts.max_group == 1) & (F.col("chunk") * opts.max_group == F.col("n") - 1)))
    name = F.concat(F.lit("exact-"), text.short_hash(F.col("norm")), F.when(F.col("n") > opts.max_group, F.concat(F.lit("-"), F.col("chunk").cast("string"))).otherwise(""))
    return roles(sized, ["norm", "chunk"]).select("norm", "chunk", name.alias("group_id"), "id", "role", "place")


def buckets(rows: DataFrame, opts: Options = Options()) -> DataFrame:  # noqa: B008
    """(domain, n, skipped) of the domains with several rows; those beyond the cap are skipped."""
    return rows.groupBy("domain").agg(F.count("*").alias("n")).where("n > 1").withColumn("skipped", F.col("n") > opts.max_bucket)


def candidate_pairs(rows: DataFrame, opts: Options = Options()) -> DataFrame:  # noqa: B008
    """(domain, a, b, shared), a < b: pairs of one bucket with common title tokens, in the best ``max_candidates`` (most
    shared, then smallest id) of either side. Buckets are capped, so no posting list exceeds ``max_bucket``."""
    usable = buckets(rows, opts).where("not skipped").select("domain")
    posts = rows.join(usable, "domain", "left_semi").select("domain", "id", F.explode(text.title_tokens(F.col("title"))).alias("token"))
    other = posts.withColumnRenamed("id", "other")
    shared = posts.join(other, ["domain", "token"]).where("id <> other").groupBy("domain", "id", "other").agg(F.count("*").alias("shared"))
    best = shared.withColumn("r", F.row_number().over(W.partitionBy("domain", "id").orderBy(F.desc("shared"), "other"))).where(F.col("r") <= opts.max_candidates)
    return best.select("domain", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "shared").distinct()


def scored_pairs(rows: DataFrame, opts: Options = Options()) -> DataFrame:  # noqa: B008
    """(domain, a, b, score) of the candidate pairs whose canonical addresses differ."""
    usable = buckets(rows, opts).where("not skipped").select("domain")
    features = Workspace(rows.sparkSession, "features").put(rows.join(usable, "domain", "left_semi").select("id", "norm", text.score_features(F.col("title"), F.col("norm")).alias("f")))
    side = lambda c: features.select(F.col("id").alias(c), F.col("norm").alias(f"n{c}"), F.col("f").alias(f"f{c}"))
    pairs = candidate_pairs(rows, opts).select("domain", "a", "b").join(side("a"), "a").join(side("b"), "b").where("na <> nb")
    return pairs.select("domain", "a", "b", text.score_of(F.col("fa"), F.col("fb")).alias("score"))


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): every vertex of an edge with the smallest vertex reachable from it. Labels shrink to the neighbours'
    minimum and then jump to their label's label, so few rounds do; each round is a table in the shared folder."""
    ws = Workspace(edges.sparkSession, "connected")
    e = ws.put(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    labels = ws.put(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("root")))
    while True:
        near = e.join(labels.select(F.col("id").alias("v"), F.col("root").alias("m")), "v").groupBy(F.col("u").alias("id")).agg(F.min("m").alias("m"))
        low = labels.join(near, "id").select("id", "root", F.least("root", "m").alias("m"))
        jump = low.select(F.col("id").alias("m"), F.col("m").alias("mm"))
        moved = ws.put(low.join(jump, "m", "left").select("id", F.least("m", F.coalesce("mm", "m")).alias("new"), "root"))
        changed = not moved.where("new <> root").isEmpty()
        ws.drop(labels)
        labels = moved.select("id", F.col("new").alias("root"))
        labels._linklake_path = moved._linklake_path
        if not changed:
            return labels


def similar_groups(rows: DataFrame, opts: Options = Options()) -> DataFrame:  # noqa: B008
    """(domain, root, piece, id, role, place, score): components of the pairs at or above the threshold, in pieces of
    ``max_group`` in the text order of ids; score is the mean of the component's edges, to three places."""
    ws = Workspace(rows.sparkSession, "similar")
    edges = ws.put(scored_pairs(rows, opts).where(F.col("score") >= opts.threshold))
    labels = connected(edges)
    scores = edges.join(labels.withColumnRenamed("id", "a"), "a").groupBy("domain", "root").agg(F.round(F.avg("score"), 3).alias("score"))
    members = rows.join(labels, "id").join(scores.drop("domain"), "root")
    sized = members.join(labels.groupBy("root").agg(F.count("*").alias("n")), "root")
    piece = F.floor((F.row_number().over(W.partitionBy("root").orderBy(F.col("id").cast("string"))) - 1) / opts.max_group)
    pieces = sized.withColumn("piece", piece).where(~((F.col("n") % opts.max_group == 1) & (F.col("piece") * opts.max_group == F.col("n") - 1)))
    return roles(pieces, ["root", "piece"]).select("domain", "root", "piece", "id", "role", "place", "score")


def find_duplicates(df: DataFrame, opts: Options = Options(), include_exact: bool = True, include_similar: bool = True) -> DataFrame:  # noqa: B008
    """(kind, group_id, key, score, id, role, place): exact groups (score 1, key the canonical address) and similar ones
    (key the domain and a hash of the members' ids). A row may be in a group of either kind."""
    rows = Workspace(df.sparkSession, "duplicates").put(valid_rows(df))
    parts = []
    if include_exact:
        parts.append(exact_groups(rows, opts).select(F.lit("exact").alias("kind"), "group_id", F.col("norm").alias("key"), F.lit(1.0).alias("score"), "id", "role", "place"))
    if include_similar:
        parts.append(named_similar(similar_groups(rows, opts)))
    if not parts:
        raise ValueError("nothing to look for")
    return reduce(DataFrame.unionByName, parts)


def named_similar(groups: DataFrame) -> DataFrame:
    """``similar_groups`` with ids: a hash of the domain and the ids of the piece's members (at most ``max_group``), and
    the piece where a component has several."""
    ids = groups.groupBy("domain", "root", "piece").agg(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ",").alias("ids"))
    pieces = groups.groupBy("root").agg(F.max("piece").alias("last"))
    # a group of one piece has no number; a second piece of one row is left out of the groups but counts
    named = ids.join(pieces, "root").select("root", "piece", F.concat(F.lit("similar-"), text.short_hash(F.concat("domain", F.lit(":"), "ids")), F.when(F.col("last") > 0, F.concat(F.lit("-"), F.col("piece").cast("string"))).otherwise("")).alias("group_id"), F.concat("domain", F.lit(":"), text.short_hash(F.col("ids"))).alias("key"))
    return groups.join(named, ["root", "piece"]).select(F.lit("similar").alias("kind"), "group_id", "key", "score", "id", "role", "place")


def by_size(groups: DataFrame) -> DataFrame:
    """(group_id, n), largest first, ties by id: the order in which groups are shown."""
    return groups.groupBy("group_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group_id")


def shown(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(group_id, id, shown_at): members of each (bounded) group newest first, null dates last; 0 is the kept one on
    screen, whatever its role."""
    dated = groups.select("group_id", "id").join(rows.select("id", "date_added"), "id")
    order = W.partitionBy("group_id").orderBy(F.col("date_added").desc_nulls_last(), "id")
    return dated.select("group_id", "id", (F.row_number().over(order) - 1).alias("shown_at"))


def statistics(df: DataFrame, opts: Options = Options()) -> DataFrame:  # noqa: B008
    """One row: scanned, exact_groups, candidate_pairs, skipped_buckets."""
    rows = Workspace(df.sparkSession, "statistics").put(valid_rows(df))
    one = lambda d, n: d.agg(F.count("*").alias("v")).select(F.lit(n).alias("k"), "v")
    exact = exact_groups(rows, opts).select("group_id").distinct()
    parts = one(rows, "scanned").union(one(exact, "exact_groups")).union(one(scored_pairs(rows, opts), "candidate_pairs")).union(one(buckets(rows, opts).where("skipped"), "skipped_buckets"))
    return parts.groupBy().pivot("k", ["scanned", "exact_groups", "candidate_pairs", "skipped_buckets"]).agg(F.first("v"))


#: Which row of a group to keep: rule -> (expression, whether the greatest wins).
KEEP_RULES = {
    "oldest": (lambda: F.col("date_added"), False),
    "newest": (lambda: F.col("date_added"), True),
    "longestUrl": (lambda: F.length("url").cast("bigint"), True),
    "shortestUrl": (lambda: F.length("url").cast("bigint"), False),
    "longestTitle": (lambda: F.length(F.coalesce("title", F.lit(""))).cast("bigint"), True),
    "shortestTitle": (lambda: F.length(F.coalesce("title", F.lit(""))).cast("bigint"), False),
}


def smart_keep(rows: DataFrame, rule: str) -> DataFrame:
    """(norm, keep_id): of every address with several rows, the one that the rule prefers; the smallest id wins ties.
    A null date counts as 0. One aggregation with partial maxima, so group sizes don't matter."""
    value, most = KEEP_RULES[rule]
    v = F.coalesce(value(), F.lit(0).cast("bigint"))
    best = F.max(F.struct((v if most else -v).alias("v"), (-F.col("id")).alias("i"))).alias("b")
    return rows.groupBy("norm").agg(best, F.count("*").alias("n")).where("n > 1").select("norm", (-F.col("b.i")).alias("keep_id"))
