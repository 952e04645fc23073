"""Plans to file links into folders: segments by a strategy, group sizes, folder roll-up, conflicts, verification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklake.functions import dates, text, urls

SEP = "\u0001"


def segments(df: DataFrame, strategy: str | Callable[[], Column], monthly: bool = False, max_depth: int = 3, classified: DataFrame | None = None) -> DataFrame:
    """``df`` with ``segments``: folder names by strategy domain, date, folder or type (needs ``classified``), or by a
    callable that gives an array column. Names are made safe for paths."""
    if callable(strategy):
        raw = strategy()
    elif strategy == "domain":
        raw = F.array(urls.let(urls.base_domain(F.col("url")), lambda h: F.when(h == "", "unknown").otherwise(F.coalesce(h, F.lit("unknown")))))
    elif strategy == "date":
        raw = dates.date_segments(dates.added_at(F.col("date_added"), F.col("id")), monthly)
    elif strategy == "folder":
        raw = F.array(F.coalesce(F.try_element_at(dates.path_array(F.col("path")), F.lit(1)), F.lit("unfiled")))
    elif strategy == "type" and classified is not None:
        df = df.join(classified.select("id", F.col("category").alias("_category")), "id", "left")
        raw = F.array(F.coalesce("_category", F.lit("other")))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return df.withColumn("segments", F.slice(F.transform(raw, lambda s: text.safe_folder(s)), 1, max_depth)).drop("_category")


def status(df: DataFrame, root: list[str], only_unfiled: bool = True) -> Column:
    """filed (already below the root), skipped (filed elsewhere while only unfiled ones move), or movable."""
    p = dates.path_array(F.col("path"))
    s = F.when((F.size(p) >= len(root)) & dates.under_root(p, root), "filed") if root else F.when(F.lit(False), "filed")
    return (s.when(F.size(p) > 0, "skipped") if only_unfiled else s).otherwise("movable")


def plan(df: DataFrame, strategy: str | Callable[[], Column], root: list[str] = ["Archive"], min_group: int = 2, only_unfiled: bool = True, **kw) -> DataFrame:  # noqa: B006
    """(id, status, group_key, segments, to_folder): what would happen to every row. status is filed, skipped, small
    (its group has under ``min_group`` members) or movable. Groups differ by their names without case; the names shown
    are the smallest spelling, taken by a partial aggregate, so a group of any size is no burden."""
    rows = segments(df.where("id is not null").withColumn("status", status(df, root, only_unfiled)), strategy, **kw)
    keyed = rows.select("id", "status", "segments", F.lower(F.array_join("segments", SEP)).alias("group_key"))
    sizes = keyed.where("status = 'movable'").groupBy("group_key").agg(F.count("*").alias("n"), F.min("segments").alias("shown"))
    j = keyed.join(sizes, "group_key", "left")
    small = (F.col("status") == "movable") & (F.col("n") < min_group)
    shown = F.coalesce("shown", "segments")
    return j.select("id", F.when(small, "small").otherwise(F.col("status")).alias("status"), "group_key", F.col("segments"), F.when((F.col("status") == "movable") & ~small, F.concat(F.array(*map(F.lit, root)), shown)).alias("to_folder"))


def folders(planned: DataFrame) -> DataFrame:
    """(path, name, n): every folder on the way to a target; only leaves count their links."""
    leaf = planned.where("to_folder is not null").groupBy("to_folder").agg(F.count("*").alias("k"))
    steps = leaf.select("k", "to_folder", F.explode(F.sequence(F.lit(1), F.size("to_folder"))).alias("i"))
    each = steps.select(F.slice("to_folder", F.lit(1), F.col("i")).alias("p"), F.when(F.col("i") == F.size("to_folder"), F.col("k")).otherwise(0).alias("k"))
    return each.groupBy("p").agg(F.sum("k").alias("n")).select(F.array_join("p", "/").alias("path"), F.element_at("p", -1).alias("name"), "n")


def conflicts(planned: DataFrame) -> DataFrame:
    """(group_key, names): groups whose members spell their folder differently."""
    names = planned.where("status in ('movable', 'small')").groupBy("group_key").agg(F.array_sort(F.collect_set(F.element_at("segments", -1))).alias("names"))
    return names.where("size(names) > 1").select("group_key", F.array_join("names", " / ").alias("names"))


def statistics(planned: DataFrame) -> DataFrame:
    c = lambda s: F.count_if(F.col("status").isin(*s))
    return planned.agg(F.count("*").alias("total"), c(["movable"]).alias("movable"), c(["filed"]).alias("already_filed"), c(["skipped", "small"]).alias("skipped"), F.coalesce(F.max(F.when(F.col("to_folder").isNotNull(), F.size("segments"))), F.lit(0)).alias("max_depth"))


def missing_folders(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """(path) of the folders to create: those of the plan that ``existing`` (path) lacks."""
    return folders(planned).select("path").join(existing.select("path"), "path", "left_anti")


def verify(planned: DataFrame, after: DataFrame) -> DataFrame:
    """(id, expected, actual) of planned moves that ``after`` (id, path array) doesn't show; actual is null if the row
    is gone."""
    ops = planned.where("to_folder is not null").select("id", "to_folder")
    j = ops.join(after.select("id", F.col("path").alias("actual")), "id", "left").where(~F.col("actual").eqNullSafe(F.col("to_folder")))
    return j.select("id", F.array_join("to_folder", "/").alias("expected"), F.array_join("actual", "/").alias("actual"))


def rule_groups(df: DataFrame, key: Column, preferred: list[str] | None = None, min_size: int = 1, other: str = "other") -> DataFrame:
    """(name, n, first_id): group sizes by a key; names outside ``preferred`` go to ``other``."""
    k = F.coalesce(key, F.lit(other))
    if preferred:
        k = F.when(k.isin(preferred), k).otherwise(other)
    return df.groupBy(k.alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") >= min_size)
