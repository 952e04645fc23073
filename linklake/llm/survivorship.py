"""Best representative of each duplicate group, field by field.

One aggregation takes, for every attribute, the maximum of a composite struct (has a value, rank of the value, smaller id
first, value). Partial aggregation reduces every map task to one struct for each group and field before the shuffle, so a
group of any size costs no more than the number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklake.functions import urls
from linklake.runtime import maybe_broadcast


def path_depth(path: Column) -> Column:
    """Number of non-blank folder names of a path joined by ``/``; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(path, "/"), lambda p: F.trim(p, F.lit(urls.EDGE)) != "")), F.lit(0))


def plausible_date(added: Column, loaded: Column) -> Column:
    """``added`` where, read as epoch milliseconds, it is above zero and not after ``loaded``; null otherwise."""
    return F.when((added > 0) & (added * 1000 <= F.unix_micros(loaded.cast("timestamp"))) & (added < 4_000_000_000_000_000), added)


def full_address(url: Column) -> Column:
    """Whether the text is http(s)://host with a dot inside the host."""
    t = urls.trimmed(url)
    return F.coalesce(t.rlike(r"^(?i:https?)://(?:[^/?#@\s]*@)?[^/?#:@\s.]+(\.[^/?#:@\s.]+)+\.?(?::[0-9]*)?(?:[/?#]|$)"), F.lit(False))


def survivors(members: DataFrame, rows: DataFrame, sources: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row for each group: group_id, n_members, and for path, date_added and url the best value and its id.

    path: most non-blank folder names. date_added: latest plausible date. url: full http(s) addresses first, then the
    most trusted source (compared without case and outer blanks; null and unlisted sources last). ``extra`` adds fields
    by a ranking expression over the columns of ``rows`` (greater is better, null is worst).
    Ties go to the smallest id. Members given twice count once; members without a row and null ids are left out. A group
    of which no member has a value still gets its smallest id, with that row's own value. Empty tables give no rows.
    Other columns of the inputs are not read, so clashing names don't matter.
    """
    trust = sources.where("source is not null").groupBy(F.lower(F.trim(F.col("source"), F.lit(urls.EDGE))).alias("_source")).agg(F.min("trust").alias("_trust"))
    r = rows.withColumn("_source", F.lower(F.trim(F.col("source"), F.lit(urls.EDGE)))).join(maybe_broadcast(trust), "_source", "left")
    ranks: dict[str, Column] = {
        "path": path_depth(F.col("path")).cast("bigint"),
        "date_added": plausible_date(F.col("date_added"), F.col("loaded_at")),
        "url": F.when(full_address(F.col("url")), F.coalesce(-F.col("_trust").cast("bigint"), F.lit(-(1 << 40)))),
    } | (extra or {})
    ranked = r.where("id is not null").select("id", *[F.struct(v.isNotNull().alias("has"), v.alias("rank"), F.col(k).alias("value")).alias(f"_{k}") for k, v in ranks.items()])
    joined = members.where("group_id is not null").select("group_id", "id").join(ranked, "id")
    best = [F.max(F.struct(F.col(f"_{k}.has"), F.col(f"_{k}.rank"), (-F.col("id")).alias("nid"), F.col(f"_{k}.value").alias("value"))).alias(f"_{k}") for k in ranks]
    out = joined.groupBy("group_id").agg(*best)
    return out.select("group_id", *[c for k in ranks for c in (F.col(f"_{k}.value").alias(k), (-F.col(f"_{k}.nid")).alias(f"{k}_id"))])


def survivor_ids(members: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(group_id, field_name, id): which member each field's value comes from."""
    s = survivors(members, rows, sources)
    fields = F.explode(F.array(*[F.struct(F.lit(k).alias("field_name"), F.col(f"{k}_id").alias("id")) for k in ("path", "date_added", "url")])).alias("f")
    return s.select("group_id", fields).select("group_id", "f.field_name", "f.id")
