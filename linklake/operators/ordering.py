"""Neighbours in an order without a window over the group: a group of any size spreads over range partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_in_group(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``next`` (``value`` of the following row of its group, null at the end) and ``is_first``.

    The rows are range-partitioned and sorted by group and order; neighbours are found while streaming a partition.
    Only the first and last row of each partition (a number bounded by the partitions, not by the data) is exchanged
    to close the seams. Ties in ``order`` must be broken by its last column. Null groups form one group.
    """
    from linklake.runtime import Workspace

    spark = df.sparkSession
    marked = df.withColumn("_g", F.struct(*group)).withColumn("_g", F.to_json("_g", {"ignoreNullFields": "false"}))
    ranged = marked.repartitionByRange(*[F.col(c).asc_nulls_first() for c in group + order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in group + order])
    ranged = Workspace(spark, "ordered").put(ranged.withColumn("_p", F.spark_partition_id()))
    ends = ranged.groupBy("_p").agg(F.min(F.struct(*group, *order, "_g", F.col(value).alias("v"))).alias("a"), F.max(F.struct(*group, *order, "_g")).alias("z"))
    ends = sorted((r["_p"], r["a"]["_g"], r["a"]["v"], r["z"]["_g"]) for r in ends.collect())
    seam = {p: (ends[i - 1][3] if i else None, *(ends[i + 1][1:3] if i + 1 < len(ends) else (None, None))) for i, (p, *_) in enumerate(ends)}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            g, p = t.column("_g").to_pylist(), t.column("_p").to_pylist()
            before = held[1] if held else seam[p[0]][0]
            first = [x != y for x, y in zip(g, [before, *g])]
            if held:
                yield from done(held[0], held[2], g[0], t.column(value)[0].as_py())
            held = (t, g[-1], first)
        if held:
            _, gg, v = seam[held[0].column("_p")[0].as_py()]
            yield from done(held[0], held[2], gg, v)

    def done(t: pa.Table, first: list, then: str | None, v) -> Iterator[pa.RecordBatch]:
        g, x = t.column("_g").to_pylist(), t.column(value).to_pylist()
        follow = [b if p == q else None for p, q, b in zip(g, [*g[1:], then], [*x[1:], v])]
        out = t.drop_columns(["_g", "_p"]).append_column("next", pa.array(follow, t.schema.field(value).type)).append_column("is_first", pa.array(first))
        yield from out.combine_chunks().to_batches()

    kind = dict(df.dtypes)[value]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", next {kind}, is_first boolean"
    # one task for each written partition, rows in their written order
    again = ranged.repartition(max(1, len(ends)), "_p").sortWithinPartitions("_p", *[F.col(c).asc_nulls_first() for c in group + order])
    return again.mapInArrow(_per_partition(walk), schema)


def _per_partition(walk):
    """Splits a task's stream at changes of ``_p``: hash partitioning may put two ranges into one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            p = b.column(b.schema.get_field_index("_p")).to_numpy(zero_copy_only=False)
            cuts = [0, *(i + 1 for i in range(len(p) - 1) if p[i] != p[i + 1]), len(p)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if p[i] != at and held:
                    yield from walk(iter(held))
                    held = []
                at = p[i]
                held.append(b.slice(i, j - i))
        if held:
            yield from walk(iter(held))

    return run


def number_in_group(df: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``df`` with the place (from 0) of each row in its group; as a row number, but a group of any size spreads over
    range partitions. Only one row a partition reaches the driver: how many rows its first and last group have there.
    Ties in ``order`` must be broken by its last column."""
    from linklake.runtime import Workspace

    keys = [F.col(c).asc_nulls_first() for c in group + order]
    ranged = df.withColumn("_g", F.to_json(F.struct(*group), {"ignoreNullFields": "false"})).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    ranged = Workspace(df.sparkSession, "numbered").put(ranged)
    counts = ranged.groupBy("_p", "_g").agg(F.count("*").alias("n"), F.min(F.struct(*group)).alias("s"))
    ends = counts.groupBy("_p").agg(F.min(F.struct("s", "_g", "n")).alias("a"), F.max(F.struct("s", "_g", "n")).alias("z"), F.count("*").alias("k"))
    start, last, carried = {}, None, 0
    for r in sorted(ends.collect(), key=lambda r: r["_p"]):
        start[r["_p"]] = carried if r["a"]["_g"] == last else 0
        carried = r["z"]["n"] + (start[r["_p"]] if r["k"] == 1 else 0)
        last = r["z"]["_g"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            t = pa.Table.from_batches([b])
            out = []
            for g, p in zip(t.column("_g").to_pylist(), t.column("_p").to_pylist()):
                if (g, p) != at:
                    n = start[p] if at is None or at[1] != p else 0
                    at = (g, p)
                out.append(n)
                n += 1
            yield from t.drop_columns(["_g", "_p"]).append_column(name, pa.array(out, pa.int64())).combine_chunks().to_batches()

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", {name} bigint"
    return ranged.repartition(max(1, len(start)), "_p").sortWithinPartitions("_p", *keys).mapInArrow(walk, schema)
