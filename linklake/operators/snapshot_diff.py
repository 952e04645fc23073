"""What changed between full snapshots, through a key-to-hash index.

``SnapshotIndex`` holds the last snapshot as a bucketed table of keys and hashes: a delivery is written with the same
buckets, the hashes are probed without a shuffle, old values are fetched for changed keys only, and the delivery becomes
the index. ``replay`` runs a whole history through it, all libraries one snapshot further with each delivery.
``diff_all`` is the bulk form: one join of the hashes of all generations, without an index and without old values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linklake.operators.ordering import next_in_group, number_in_group
from linklake.runtime import Workspace, maybe_broadcast, parallelism, shared_dir


def row_hash(columns: list[str]) -> list[Column]:
    """128 bits over the values as they stand; null differs from every text, and values don't run together."""
    marked = [F.struct(F.col(c).isNull().alias("n"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("v")) for c in columns]
    return [F.xxhash64(*marked).alias("h1"), F.xxhash64(F.lit(7), *marked).alias("h2")]


def latest_hashes(rows: DataFrame, keys: list[str], columns: list[str], loaded: str) -> DataFrame:
    """One index entry for each key: the hash of the row loaded last. Null load times come first; ties go to the
    greater hash, which is the same on every run."""
    hashed = rows.select(*keys, F.struct(F.col(loaded).alias("at"), *row_hash(columns)).alias("r"))
    return hashed.groupBy(*keys).agg(F.max("r").alias("r")).select(*keys, F.col("r.h1").alias("h1"), F.col("r.h2").alias("h2"))


def diff_all(snapshots: DataFrame, rows: DataFrame, columns: list[str] = ["parent_id", "title", "url"]) -> DataFrame:  # noqa: B006
    """(snapshot_id, id, change_kind) for every two snapshots of a library that follow each other by created_at.

    Repeated snapshot rows count once, equal times are ordered by snapshot_id, null times come first. Rows of unknown
    snapshots and rows with a null id or snapshot_id are left out. A library's first snapshot gives nothing; an empty
    snapshot in between makes its library's nodes ``removed`` and later ``added``. Empty tables give no rows.
    """
    order = snapshots.select("library_id", "created_at", "snapshot_id").where("snapshot_id is not null").groupBy("snapshot_id").agg(F.max(F.struct("library_id", "created_at")).alias("s")).select("snapshot_id", "s.*")
    chain = next_in_group(order, ["library_id"], ["created_at", "snapshot_id"], "snapshot_id")
    chain = chain.select("snapshot_id", "is_first", F.col("next").alias("prober"))
    index = latest_hashes(rows.where("snapshot_id is not null and id is not null"), ["snapshot_id", "id"], columns, "loaded_at").join(chain, "snapshot_id")
    new = index.where("not is_first").select("snapshot_id", "id", "h1", "h2")
    old = index.where("prober is not null").select(F.col("prober").alias("snapshot_id"), "id", F.col("h1").alias("o1"), F.col("h2").alias("o2"))
    probed = new.join(old, ["snapshot_id", "id"], "full_outer")
    kind = F.when(F.col("o1").isNull(), "added").when(F.col("h1").isNull(), "removed").when((F.col("h1") != F.col("o1")) | (F.col("h2") != F.col("o2")), "changed")
    return probed.select("snapshot_id", "id", kind.alias("change_kind")).where("change_kind is not null")


class SnapshotIndex:
    """The last snapshot: a table of (keys, h1, h2, value columns), bucketed and sorted by the keys.

    It lies in the shared folder under a name of its own; probing reads its keys and hashes only. ``keys`` are compared
    as they stand; rows with a null key are left out. Of several rows with one key the one loaded last counts.
    """

    def __init__(self, spark: SparkSession, keys: list[str], columns: list[str], loaded: str, buckets: int | None = None):
        self.spark, self.keys, self.columns, self.loaded = spark, keys, columns, loaded
        self.buckets, self.name = buckets or parallelism(spark), f"snapshot_index_{uuid.uuid4().hex}"
        self.generation, self.current, self.ws = 0, None, Workspace(spark, "changes")

    def _write(self, rows: DataFrame) -> str:
        """One file a bucket: the rows are put into the buckets' partitions once, which serves the grouping as well."""
        self.generation += 1
        table = f"{self.name}_{self.generation}"
        r = rows.dropna(subset=self.keys).select(*self.keys, F.struct(F.col(self.loaded).alias("at"), *row_hash(self.columns), *self.columns).alias("r"))
        last = r.repartition(self.buckets, *self.keys).groupBy(*self.keys).agg(F.max("r").alias("r"))
        entries = last.select(*self.keys, "r.h1", "r.h2", *[F.col(f"r.{c}") for c in self.columns])
        path = f"{shared_dir(self.spark).rstrip('/')}/{table}"
        entries.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", path).saveAsTable(table)
        return table

    def apply(self, rows: DataFrame, scope: DataFrame | None = None) -> DataFrame:
        """(keys, change_kind, old, new) of a delivery against the last one, which it then replaces. ``old`` and ``new``
        are structs of the value columns, null where the key wasn't there. With ``scope`` (some key columns), entries of
        the index outside it are not compared; inside it, keys that the delivery lacks are removed."""
        last, self.current = self.current, self._write(rows)
        new = self.spark.table(self.current)
        values = F.struct(*self.columns)
        if last is None:
            out = new.select(*self.keys, F.lit("added").alias("change_kind"), F.when(F.lit(False), values).alias("old"), values.alias("new"))
            return self.ws.put(out)
        old = self.spark.table(last)
        hashes = old.select(*self.keys, "h1", "h2")
        if scope is not None:
            hashes = hashes.join(maybe_broadcast(scope), scope.columns, "left_semi")
        probed = new.select(*self.keys, F.col("h1").alias("n1"), F.col("h2").alias("n2")).join(hashes.hint("merge"), self.keys, "full_outer")
        kind = F.expr("case when h1 is null then 'added' when n1 is null then 'removed' when h1 <> n1 or h2 <> n2 then 'changed' end")
        hits = self.ws.put(probed.select(*self.keys, kind.alias("change_kind")).where("change_kind is not null"))
        fetch = lambda table, name, lacking: hits.where(f"change_kind <> '{lacking}'").join(table.select(*self.keys, values.alias(name)), self.keys)
        olds, news = fetch(old, "old", "added"), fetch(new, "new", "removed").select(*self.keys, "new")
        out = self.ws.put(hits.join(olds.select(*self.keys, "old"), self.keys, "left").join(news, self.keys, "left"))
        self.ws.drop(hits)
        self._forget(last)
        return out

    def probe(self, rows: DataFrame, scope: DataFrame | None = None) -> DataFrame:
        """As ``apply``, without values: (keys, change_kind)."""
        last, self.current = self.current, self._write(rows)
        new = self.spark.table(self.current).select(*self.keys, F.col("h1").alias("n1"), F.col("h2").alias("n2"))
        if last is None:
            return self.ws.put(new.select(*self.keys, F.lit("added").alias("change_kind")))
        hashes = self.spark.table(last).select(*self.keys, "h1", "h2")
        if scope is not None:
            hashes = hashes.join(maybe_broadcast(scope), scope.columns, "left_semi")
        kind = F.expr("case when h1 is null then 'added' when n1 is null then 'removed' when h1 <> n1 or h2 <> n2 then 'changed' end")
        out = self.ws.put(new.join(hashes.hint("merge"), self.keys, "full_outer").select(*self.keys, kind.alias("change_kind")).where("change_kind is not null"))
        self._forget(last)
        return out

    def _forget(self, table: str | None) -> None:
        if table:
            self.spark.sql(f"drop table if exists {table}")
            self.ws.delete(f"{shared_dir(self.spark).rstrip('/')}/{table}")

    def drop(self) -> None:
        self._forget(self.current)
        self.current = None


def replay(snapshots: DataFrame, rows: DataFrame, columns: list[str] = ["parent_id", "title", "url"], values: bool = False) -> DataFrame:  # noqa: B006
    """(snapshot_id, id, change_kind), and old and new with ``values``: as ``diff_all``, through a ``SnapshotIndex``.

    Delivery k holds the k-th snapshot of every library that has so many. The number of deliveries is that of the
    longest history, not of the snapshots.
    """
    spark = snapshots.sparkSession
    ws = Workspace(spark, "replay")
    known = snapshots.where("snapshot_id is not null").groupBy("snapshot_id").agg(F.max(F.struct("library_id", "created_at")).alias("s")).select("snapshot_id", "s.*")
    named = known.select("snapshot_id", "created_at", F.to_json(F.struct("library_id"), {"ignoreNullFields": "false"}).alias("library"))
    chain = ws.put(number_in_group(named, ["library"], ["created_at", "snapshot_id"]).select("snapshot_id", "library", "place"))
    deliveries = (chain.agg(F.max("place")).first()[0] or 0) + 1
    staged = ws.put(rows.where("id is not null").select("snapshot_id", "id", "loaded_at", *columns).join(maybe_broadcast(chain), "snapshot_id").drop("snapshot_id"), partition_by=["place"])
    index = SnapshotIndex(spark, ["library", "id"], columns, "loaded_at")
    out = None
    for k in range(deliveries):
        now = chain.where(F.col("place") == k)
        delivered = staged.where(F.col("place") == k)
        found = (index.apply if values else index.probe)(delivered, now.select("library"))
        if k:
            part = found.join(maybe_broadcast(now.select("library", "snapshot_id")), "library").select("snapshot_id", "id", "change_kind", *(("old", "new") if values else ()))
            out = part if out is None else out.union(part)
    index.drop()
    if out is None:
        return diff_all(snapshots.limit(0), rows.limit(0), columns)
    return out
