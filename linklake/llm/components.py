"""Pairwise matches to groups by seed-tree pruning.

Each round every vertex proposes the smallest vertex of its neighbourhood to all its neighbours. A vertex that nobody
proposes to itself leaves the graph and hangs below its best proposal in the propagation forest; the others are linked
to their best proposal and go on. The graph shrinks geometrically, so there are O(log n) rounds. At the end the seeds'
ids flow down the forest, last-pruned layers first. No neighbourhood is ever gathered: minima are partial aggregates and
the joins are many-to-one, so a vertex with a third of all pairs is a skewed key of one side, which adaptive execution
splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklake.runtime import Workspace


def groups(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(first_id, id) of every vertex linked to at least one other, first_id being the smallest id of its group.

    Repeated, reversed and looped pairs and pairs with a null side add nothing; a vertex with only a loop to itself is
    not listed. An empty table gives no rows. Other columns are not read.
    """
    ws = Workspace(pairs.sparkSession, "components")
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = ws.put(both.union(both.select("v", "u")).distinct())
    layers: list[DataFrame] = []
    seeds = None
    while True:
        low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # proposals: each vertex's minimum, to its neighbours and to itself
        proposed = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("to")).union(low.select("u", F.col("m").alias("to"))).distinct()
        proposed = ws.put(proposed)
        best = proposed.groupBy("u").agg(F.min("to").alias("best"), F.max((F.col("to") == F.col("u")).cast("int")).alias("own"), F.count("*").alias("n"))
        best = ws.put(best)
        layers.append(best.where("own = 0").select("u", F.col("best").alias("up")))
        found = best.where("own = 1 and n = 1").select("u")
        linked = proposed.join(best.select("u", "best"), "u").where("to <> best").select(F.col("to").alias("u"), F.col("best").alias("v"))
        following = ws.put(linked.union(linked.select("v", "u")).distinct())
        ws.drop(edges)
        ws.drop(proposed)
        edges = following
        # a seed may still be named by later rounds' links; only vertices without any are final
        final = ws.put(found.join(edges.select("u").distinct(), "u", "left_anti"))
        seeds = final if seeds is None else seeds.union(final)
        if edges.isEmpty():
            break
    labelled = seeds.select("u", F.col("u").alias("first_id"))
    for layer in reversed(layers):
        down = ws.put(layer.join(labelled.select(F.col("u").alias("up"), "first_id"), "up").select("u", "first_id"))
        labelled = labelled.union(down)
    return labelled.select("first_id", F.col("u").alias("id"))
