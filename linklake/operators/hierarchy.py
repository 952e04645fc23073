"""Parent-child rows to full hierarchies by pointer doubling.

Only nodes with children take part in the rounds; all others are settled at the end by one join with their parent. Every
inner node holds a pointer to an ancestor; a round joins pointers with pointers, which doubles the distance, and a node
leaves the rounds when its pointer has reached a root. Chains of length L need log2 L rounds. What is left when the
distance exceeds the number of nodes left lies on or below a cycle; the smallest id between a node and its pointer, which
the rounds carry along, is then the smallest id on the cycle. Path segments are concatenated in rounds of their own, after
the nodes at cycles are known, because their segments would grow with every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklake.runtime import Workspace, not_blank


def current_nodes(nodes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each id: the one loaded last (null load times first, ties to the greater remaining values).
    Rows with a null or blank id are no nodes."""
    keep = columns or ["parent_id", "idx", "title", "url"]
    best = nodes.where(not_blank(F.col("id"))).groupBy("id").agg(F.max(F.struct("loaded_at", *keep)).alias("r"))
    return best.select("id", *[F.col(f"r.{c}").alias(c) for c in keep])


def resolve(nodes: DataFrame, segment: Column | None = None, ws: Workspace | None = None, cut_cycles: bool = False) -> DataFrame:
    """(id, parent, root_id, depth, segments) for a table with unique ids and the column parent_id.

    A node whose parent_id is null, blank or no id of the table is a root of depth 0. Nodes on or below a cycle, their
    own parent included, get depth -1, the smallest id on the cycle as root_id and null segments. ``segments`` holds the
    value of ``segment``, of any type, of every node from the root to the node itself; it is null if no segment is asked
    for. With ``cut_cycles`` the nodes on cycles count as roots, so that what hangs below them is a tree. An empty
    table gives an empty result.
    """
    ws = ws or Workspace(nodes.sparkSession, "hierarchy")
    seg = segment if segment is not None else F.lit(None).cast("string")
    base = ws.put(nodes.select("id", F.when(not_blank(F.col("parent_id")), F.col("parent_id")).alias("p"), seg.alias("seg")))
    inner, ring = _inner(base, ws), None
    done, stuck, rounds = _roots(inner, ws)
    if stuck is not None:
        # all pointers have jumped at least as far as there are such nodes, so they lie on cycles and the cycles' nodes
        # have been round them
        ring = stuck.join(stuck.select(F.col("up").alias("id")).distinct(), "id", "left_semi").select("id", "low")
        if cut_cycles:
            base = ws.put(base.join(ring.select("id", F.lit(True).alias("cut")), "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("p")).alias("p"), "seg"))
            inner, ring = _inner(base, ws), None
            done, _, rounds = _roots(inner, ws)
        else:
            ring = stuck.select("id", "up").join(ring.select(F.col("id").alias("up"), "low"), "up").select("id", F.col("low").alias("root_id"), F.lit(-1).alias("depth"))
    above, kind = done.select("id", "root_id", "depth"), f"array<{dict(base.dtypes)['seg']}>"
    if segment is not None:
        above = above.join(_paths(base, inner, done, rounds, ws), "id")
    else:
        above = above.withColumn("up_segments", F.lit(None).cast(kind))
    if ring is not None:
        above = above.unionByName(ring.withColumn("up_segments", F.lit(None).cast(kind)))
    above = above.select(F.col("id").alias("p"), F.col("root_id").alias("r"), F.col("depth").alias("d"), "up_segments")
    # a crowded parent is a skewed key of the large side only, which adaptive execution splits
    out = base.join(above.hint("merge"), "p", "left")
    own = F.array("seg") if segment is not None else F.lit(None).cast(kind)
    segments = F.when(F.col("d").isNull(), own).when(F.col("d") >= 0, F.concat("up_segments", own))
    depth = F.when(F.col("d").isNull(), 0).when(F.col("d") < 0, -1).otherwise(F.col("d") + 1)
    return out.select("id", F.when(F.col("d").isNotNull(), F.col("p")).alias("parent"), F.coalesce("r", "id").alias("root_id"), depth.alias("depth"), segments.alias("segments"))


def _inner(base: DataFrame, ws: Workspace) -> DataFrame:
    """(id, parent) of the nodes with children; parent is null where it is no node."""
    named = base.where("p is not null").select(F.col("p").alias("id")).distinct()
    found = base.join(named, "id", "left_semi").select("id", "p")
    known = found.select(F.col("id").alias("p"), F.lit(True).alias("known"))
    return ws.put(found.join(known, "p", "left").select("id", F.when(F.col("known"), F.col("p")).alias("parent")))


def _roots(inner: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame | None, int]:
    """(id, root_id, depth) of the nodes that reach a root; (id, up, low) of those that don't, if any; the number of
    rounds in which nodes left. ``low`` is the smallest id from the node's parent up to ``up``."""
    done = inner.where("parent is null").select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"))
    open_ = inner.where("parent is not null").select("id", F.col("parent").alias("up"), F.lit(1).alias("step"), F.col("parent").alias("low"))
    left, reach, rounds, last = None, 1, 0, False
    while left is None or left:
        ahead = open_.select(F.col("id").alias("up"), F.col("up").alias("to"), F.col("step").alias("more"), F.col("low").alias("low2"), F.lit(False).alias("hit"))
        if not last:
            ends = done.select(F.col("id").alias("up"), F.col("root_id").alias("to"), F.col("depth").alias("more"), F.lit(None).cast("string").alias("low2"), F.lit(True).alias("hit"))
            ahead = ahead.union(ends)
        moved, n = ws.put_counted(open_.join(ahead, "up").select("id", "to", (F.col("step") + F.col("more")).alias("step"), F.least("low", "low2").alias("low"), "hit"), open=F.count_if(~F.col("hit")), hit=F.count_if(F.col("hit")))
        if n["hit"]:
            done = done.union(moved.where("hit").select("id", F.col("to").alias("root_id"), F.col("step").alias("depth")))
            rounds += 1
        open_ = moved.where("not hit").select("id", F.col("to").alias("up"), "step", "low")
        left, reach = n["open"], reach * 2
        # the chain to a root has nodes of every depth, so a round without hits ends them: what is left is at cycles
        last = not n["hit"]
        if left and last and reach >= left:
            return done, open_.select("id", "up", "low"), rounds
    return done, None, rounds


def _paths(base: DataFrame, inner: DataFrame, done: DataFrame, rounds: int, ws: Workspace) -> DataFrame:
    """(id, up_segments) of the inner nodes that reach a root: the segments from the root down to the node."""
    start = ws.put(inner.join(done.select("id"), "id", "left_semi").join(base.select("id", F.array("seg").alias("segments")), "id"))
    out = start.where("parent is null").select("id", "segments")
    open_ = start.where("parent is not null").select("id", F.col("parent").alias("up"), "segments")
    for _ in range(rounds):
        ends = out.select(F.col("id").alias("up"), F.lit(None).cast("string").alias("to"), F.col("segments").alias("before"))
        ahead = open_.select(F.col("id").alias("up"), F.col("up").alias("to"), F.col("segments").alias("before"))
        # long arrays compress well, so the size of their file says nothing: never broadcast them
        moved = ws.put(open_.join(ends.union(ahead).hint("merge"), "up").select("id", "to", F.concat("before", "segments").alias("segments")))
        out = out.union(moved.where("to is null").select("id", "segments"))
        open_ = moved.where("to is not null").select("id", F.col("to").alias("up"), "segments")
    return out.select("id", F.col("segments").alias("up_segments"))


def sibling_key(idx: Column, id_: Column) -> Column:
    """Sorts siblings by idx, then id; a null idx comes last. Joined from the root down it sorts a tree in preorder."""
    return F.concat(F.coalesce(F.lpad(F.when(idx >= 0, idx).cast("string"), 10, "0"), F.lit("~~~~~~~~~~")), F.lit(":"), id_)


def full_hierarchy(nodes: DataFrame) -> DataFrame:
    """(id, parent_id, root_id, depth, path, order_key) of the current rows: ``path`` has the titles from the root down
    (null and blank titles as ''), ``order_key`` sorts a root's nodes in preorder, siblings by idx. Both are null for
    nodes at a cycle, which are the ones with depth -1."""
    cur = current_nodes(nodes)
    r = resolve(cur, F.struct(sibling_key(F.col("idx"), F.col("id")).alias("k"), F.coalesce(F.trim("title"), F.lit("")).alias("t")))
    return r.select("id", F.col("parent").alias("parent_id"), "root_id", "depth", F.col("segments.t").alias("path"), F.array_join("segments.k", "/").alias("order_key"))


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance, order_key): every node below every node, one row each, in preorder by order_key.
    It explodes the ids on each node's own path, so the output is as large as the sum of all depths and no group is
    gathered. Nodes on a cycle, which are all below each other, count as roots here: they have no ancestors, and what
    hangs below each of them is listed."""
    cur = current_nodes(nodes)
    r = resolve(cur, F.struct(F.col("id").alias("i"), sibling_key(F.col("idx"), F.col("id")).alias("k")), cut_cycles=True)
    ids, key = F.col("segments.i"), F.array_join("segments.k", "/")
    up = r.where("depth > 0").select("id", "depth", key.alias("order_key"), F.posexplode(F.slice(ids, F.lit(1), F.col("depth"))).alias("level", "ancestor_id"))
    return up.select("ancestor_id", "id", (F.col("depth") - F.col("level")).alias("distance"), "order_key")


def below(cur: DataFrame, root_id: str) -> DataFrame:
    """(id) of the nodes below one node of a table with unique ids: those that have it on their path. Cycles are cut as
    in ``descendants``."""
    r = resolve(cur, F.col("id"), cut_cycles=True)
    return r.where((F.col("depth") > 0) & F.array_contains(F.slice("segments", F.lit(1), F.greatest("depth", F.lit(1))), root_id)).select("id")
