"""Validation and import of link records against a library, with conflict policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklake.functions import urls


def _keyed(records: DataFrame) -> DataFrame:
    valid = urls.is_valid(F.col("url"))
    return records.withColumn("_norm", F.when(valid, urls.normalize(F.col("url")))).withColumn("_error", F.when(F.coalesce(urls.trimmed(F.col("url")), F.lit("")) == "", "missing url").when(~valid, "invalid url"))


def validate(records: DataFrame) -> DataFrame:
    """(id, error, duplicate_of): what is wrong with a record, and the first record (smallest id) of the same address."""
    k = _keyed(records).select("id", "_norm", "_error")
    first = k.where("_norm is not null").groupBy("_norm").agg(F.min("id").alias("first"))
    return k.join(first, "_norm", "left").select("id", F.col("_error").alias("error"), F.when(F.col("first") < F.col("id"), F.col("first")).alias("duplicate_of"))


def plan_import(incoming: DataFrame, library: DataFrame, policy: str = "skip") -> DataFrame:
    """(id, action): failed, skipped, created, or replaced (created after its namesakes in the library are deleted).

    skip: an address that the library has or that came before in the batch (smaller id) is skipped. duplicate: all valid
    records are created. overwrite: namesakes in the library are replaced; every record of the batch is created."""
    k = _keyed(incoming).select("id", "_norm", "_error")
    have = _keyed(library).where("_norm is not null").select("_norm").distinct().withColumn("_have", F.lit(True))
    first = k.where("_norm is not null").groupBy("_norm").agg(F.min("id").alias("_first"))
    j = k.join(have, "_norm", "left").join(first, "_norm", "left")
    exists, later = F.coalesce("_have", F.lit(False)), F.col("_first") < F.col("id")
    action = F.when(F.col("_error").isNotNull(), "failed")
    if policy == "skip":
        action = action.when(exists | later, "skipped")
    elif policy == "overwrite":
        action = action.when(exists & ~later, "replaced")
    elif policy != "duplicate":
        raise ValueError(f"unknown policy {policy!r}")
    return j.select("id", action.otherwise("created").alias("action"))


def merged(incoming: DataFrame, library: DataFrame, policy: str = "skip") -> DataFrame:
    """The library after the import: id, title, url, and ``origin`` (library or import). A dry run is ``plan_import``."""
    plan = plan_import(incoming, library, policy)
    new = incoming.join(plan.where("action in ('created', 'replaced')"), "id", "left_semi")
    old = library
    if policy == "overwrite":
        gone = _keyed(new).select("_norm").distinct()
        old = _keyed(library).join(gone, "_norm", "left_anti")
    cols = ["id", "title", "url"]
    return old.select(*cols, F.lit("library").alias("origin")).unionByName(new.select(*cols, F.lit("import").alias("origin")))
