"""Snapshots of a tree: take, list, prune, restore."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def take(nodes: DataFrame, snapshot_id: str, created_at: str, action: str) -> DataFrame:
    """Rows of one snapshot; id and time are parameters, so a repeated run gives the same rows."""
    return nodes.select(F.lit(snapshot_id).alias("snapshot_id"), F.lit(created_at).cast("timestamp").alias("created_at"), F.lit(action).alias("action"), *nodes.columns)


def newest(snapshots: DataFrame, keep: int = 5) -> DataFrame:
    """The ``keep`` newest snapshots of each library, repeated rows once, ties by id. Window group limits cut every
    task's rows to ``keep`` before the shuffle."""
    s = snapshots.select("snapshot_id", "library_id", "created_at").distinct()
    return s.withColumn("place", F.row_number().over(W.partitionBy("library_id").orderBy(F.desc("created_at"), "snapshot_id"))).where(F.col("place") <= keep)


def prune(rows: DataFrame, snapshots: DataFrame, keep: int = 5) -> DataFrame:
    """Snapshot rows of the newest snapshots only."""
    return rows.join(newest(snapshots, keep).select("snapshot_id"), "snapshot_id", "left_semi")


def restore(rows: DataFrame, snapshot_id: str, prefix: str = "r") -> DataFrame:
    """The snapshot's nodes with new ids (``prefix`` + old id) and parents mapped to them; a parent outside the snapshot
    is kept as it is."""
    s = rows.where(F.col("snapshot_id") == snapshot_id)
    best = s.groupBy("id").agg(F.max(F.struct("loaded_at", "parent_id", "idx", "title", "url")).alias("r")).select("id", "r.*")
    known = best.select(F.col("id").alias("parent_id"), F.concat(F.lit(prefix), "id").alias("_new"))
    return best.join(known, "parent_id", "left").select(F.concat(F.lit(prefix), "id").alias("id"), F.coalesce("_new", "parent_id").alias("parent_id"), "idx", "title", "url")


def counts(rows: DataFrame) -> DataFrame:
    """(snapshot_id, bookmarks, folders, total), repeated deliveries of a node counted once."""
    one = rows.groupBy("snapshot_id", "id").agg(F.max(F.struct("loaded_at", "parent_id", "idx", "title", "url")).alias("r"))
    link = F.coalesce(F.col("r.url") != "", F.lit(False))
    return one.groupBy("snapshot_id").agg(F.count_if(link).alias("bookmarks"), F.count_if(~link).alias("folders"), F.count("*").alias("total"))


def listed(snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    """(snapshot_id, library_id, created_at, action, total), newest first; repeated rows once."""
    n = rows.groupBy("snapshot_id").agg(F.count_distinct("id").alias("total"))
    one = snapshots.groupBy("snapshot_id").agg(F.max(F.struct("created_at", "library_id", "action")).alias("s")).select("snapshot_id", "s.*")
    return one.join(n, "snapshot_id", "left").select("snapshot_id", "library_id", "created_at", "action", F.coalesce("total", F.lit(0)).alias("total")).orderBy(F.desc("created_at"), "snapshot_id")


def get(rows: DataFrame, snapshot_id: str) -> DataFrame:
    """The nodes of one snapshot, each once, the row loaded last."""
    best = rows.where(F.col("snapshot_id") == snapshot_id).groupBy("id").agg(F.max(F.struct("loaded_at", "parent_id", "idx", "title", "url")).alias("r"))
    return best.select("id", "r.parent_id", "r.idx", "r.title", "r.url")


def deleted(rows: DataFrame, snapshot_ids: list[str]) -> DataFrame:
    return rows.where(~F.col("snapshot_id").isin(snapshot_ids))


def cleared(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def restore_tree(rows: DataFrame, snapshot_id: str, builtin: list[str] = ["0", "1", "2", "3"], prefix: str = "r") -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(nodes, counts): as ``restore``, but built-in roots keep their ids and are not created again; counts has created and
    total."""
    s = get(rows, snapshot_id)
    kept = lambda c: F.when(c.isin(builtin), c).otherwise(F.concat(F.lit(prefix), c))
    known = s.select(F.col("id").alias("parent_id"), F.lit(True).alias("_k"))
    new = s.join(known, "parent_id", "left").select(kept(F.col("id")).alias("id"), F.when(F.col("_k"), kept(F.col("parent_id"))).otherwise(F.col("parent_id")).alias("parent_id"), "idx", "title", "url", (~F.col("id").isin(builtin)).alias("created"))
    return new, new.agg(F.count_if("created").alias("created"), F.count("*").alias("total"))
