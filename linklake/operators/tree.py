"""Operators over bookmark trees held as rows (id, parent_id, idx, title, url, ...); folders have no url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklake.operators import hierarchy
from linklake.runtime import Workspace, not_blank


def is_folder() -> Column:
    return ~F.coalesce(not_blank(F.col("url")), F.lit(False))


def located(nodes: DataFrame) -> DataFrame:
    """Current rows with root_id, depth, and path: the non-blank titles of the ancestors from the root down, the node
    itself left out. Nodes at a cycle have a null path."""
    ws = Workspace(nodes.sparkSession, "located")
    cur = ws.put(hierarchy.current_nodes(nodes, ["parent_id", "idx", "title", "url", "date_added", "library_id"]))
    r = hierarchy.resolve(cur, F.coalesce(F.trim("title"), F.lit("")), ws).select("id", "root_id", "depth", F.filter(F.slice("segments", 1, F.greatest(F.size("segments") - 1, F.lit(0))), lambda s: s != "").alias("path"))
    return cur.join(r, "id")


def bookmarks(nodes: DataFrame) -> DataFrame:
    """Flat bookmarks: id, title (address if blank), url, date_added (0 if null), parent_id, idx, path."""
    return located(nodes).where(~is_folder()).select("id", F.when(not_blank(F.col("title")), F.col("title")).otherwise(F.col("url")).alias("title"), "url", F.coalesce("date_added", F.lit(0)).alias("date_added"), "parent_id", "idx", "path")


def folders(nodes: DataFrame) -> DataFrame:
    """Flat folders with a title: id, title, parent_id, child_count, path."""
    all_ = located(nodes)
    n = all_.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("child_count"))
    return all_.where(is_folder() & not_blank(F.col("title"))).join(n, "id", "left").select("id", "title", "parent_id", F.coalesce("child_count", F.lit(0)).alias("child_count"), "path")


def children(nodes: DataFrame, parent_id: str) -> DataFrame:
    return hierarchy.current_nodes(nodes).where(F.col("parent_id") == parent_id).orderBy("idx", "id")


def node(nodes: DataFrame, id_: str) -> DataFrame:
    """The current row of one id; the filter reaches the scan."""
    return hierarchy.current_nodes(nodes.where(F.col("id") == id_))


def trash(nodes: DataFrame, parent_id: str, title: str, legacy: list[str] = []) -> DataFrame:  # noqa: B006
    """(new version with a folder for discarded nodes below ``parent_id``): one with the title stays, else one with a
    legacy title (the smallest id) is renamed, else one is made. ``nodes`` has unique ids."""
    here = nodes.where(is_folder() & (F.col("parent_id") == parent_id))
    if not here.where(F.col("title") == title).isEmpty():
        return nodes
    old = here.where(F.col("title").isin(legacy)).agg(F.min("id")).first()[0] if legacy else None
    if old is not None:
        return nodes.withColumn("title", F.when(F.col("id") == old, title).otherwise(F.col("title")))
    wanted = nodes.sparkSession.createDataFrame([(parent_id, title)], "parent_id string, title string")
    return nodes.unionByName(ensure_folders(nodes, wanted), allowMissingColumns=True)


def inserted(nodes: DataFrame, parsed: DataFrame, parent_id: str, prefix: str = "i") -> DataFrame:
    """``nodes`` with the rows of ``from_json_tree`` below ``parent_id``; new ids are ``prefix`` and the place in the tree."""
    at = lambda key: F.concat(F.lit(prefix), F.array_join(F.transform(key, lambda i: i.cast("string")), "."))
    up = F.when(F.size("order_key") > 1, at(F.slice("order_key", 1, F.greatest(F.size("order_key") - 1, F.lit(1))))).otherwise(F.lit(parent_id))
    return nodes.unionByName(parsed.select(at(F.col("order_key")).alias("id"), up.alias("parent_id"), "idx", "title", "url"), allowMissingColumns=True)


def counts(nodes: DataFrame) -> DataFrame:
    """One row: bookmarks, folders, total."""
    cur = hierarchy.current_nodes(nodes)
    return cur.agg(F.count_if(~is_folder()).alias("bookmarks"), F.count_if(is_folder()).alias("folders"), F.count("*").alias("total"))


def duplicate_folders(nodes: DataFrame) -> DataFrame:
    """(parent_id, name, n, first_id): folders of one parent whose titles agree but for case."""
    cur = hierarchy.current_nodes(nodes).where(is_folder() & not_blank(F.col("title")) & not_blank(F.col("parent_id")))
    return cur.groupBy("parent_id", F.lower("title").alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def empty_folders(nodes: DataFrame) -> DataFrame:
    """(id, depth) of the folders without a bookmark anywhere below; deleting leaves until nothing changes removes
    exactly these. Folders at a cycle are left out, as they have no subtree. An anti-join against the ancestors of all
    bookmarks, so no subtree is gathered."""
    ws = Workspace(nodes.sparkSession, "empties")
    cur = ws.put(hierarchy.current_nodes(nodes))
    r = ws.put(hierarchy.resolve(cur, F.col("id"), ws).where("depth >= 0").join(cur.select("id", is_folder().alias("folder")), "id"))
    full = r.where("not folder").select(F.explode("segments").alias("id")).distinct()
    return r.where("folder").select("id", "depth").join(full, "id", "left_anti")


def deepest_first(folders: DataFrame) -> DataFrame:
    """Empty folders in the order in which they can be deleted one by one."""
    return folders.orderBy(F.desc("depth"), "id")


def without(folders: DataFrame, excluded: DataFrame) -> DataFrame:
    """Folders but for those of another list (duplicates, or the folder of discarded nodes)."""
    return folders.join(excluded.select("id").distinct(), "id", "left_anti")


def descendant_titles(nodes: DataFrame, root_id: str) -> DataFrame:
    """(title): distinct titles of the folders below a node."""
    cur = hierarchy.current_nodes(nodes)
    below = hierarchy.below(cur, root_id)
    return cur.where(is_folder() & not_blank(F.col("title"))).join(below, "id", "left_semi").select("title").distinct()


def from_json_tree(trees: DataFrame, column: str, max_depth: int = 64) -> DataFrame:
    """Rows in preorder from nested JSON ({id, title, url, children}): id, parent_id, idx, title, url, order_key.

    Sibling place is the place in ``children``; parent_id the enclosing node. Levels are unnested one by one until none
    is left, ``max_depth`` at most, beyond which an error is raised rather than rows lost. Text that is no JSON gives no
    rows."""
    ws = Workspace(trees.sparkSession, "json_tree")
    v = F.try_parse_json(F.col(column))
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    level = trees.where(v.isNotNull()).select(F.lit(None).cast("string").alias("parent_id"), F.posexplode(items).alias("idx", "v"), F.array().cast("array<int>").alias("order_key"))
    out = None
    for _ in range(max_depth):
        get = lambda p, t="string": F.try_variant_get("v", f"$.{p}", t)
        rows = level.select("parent_id", "idx", get("id").alias("id"), get("title").alias("title"), get("url").alias("url"), F.to_json(get("children", "variant")).alias("children"), F.concat("order_key", F.array("idx")).alias("order_key"))
        rows = ws.put(rows)
        out = rows if out is None else out.unionByName(rows)
        deeper = rows.where("children is not null and children <> '[]'")
        if deeper.isEmpty():
            return out.drop("children")
        level = deeper.select(F.col("id").alias("parent_id"), F.posexplode(F.try_variant_get(F.parse_json("children"), "$", "array<variant>")).alias("idx", "v"), "order_key")
    raise ValueError(f"the tree is deeper than {max_depth}")


def move(nodes: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new version, undo log): ``moves`` has id and to_parent. The undo log has id, parent_id and idx as they were;
    ids that are not in ``nodes`` change nothing."""
    m = moves.where("id is not null").groupBy("id").agg(F.max("to_parent").alias("to_parent"))
    undo = nodes.join(m, "id", "left_semi").select("id", "parent_id", "idx")
    new = nodes.join(m, "id", "left").withColumn("parent_id", F.coalesce("to_parent", "parent_id")).drop("to_parent")
    return new, undo


def undo(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """The version before ``move``: parent and place from the log where it has the node."""
    old = log.select("id", F.struct("parent_id", "idx").alias("_old"))
    j = nodes.join(old, "id", "left")
    return j.withColumn("parent_id", F.when(F.col("_old").isNotNull(), F.col("_old.parent_id")).otherwise(F.col("parent_id"))).withColumn("idx", F.when(F.col("_old").isNotNull(), F.col("_old.idx")).otherwise(F.col("idx"))).drop("_old")


def delete_subtree(nodes: DataFrame, root_id: str, keep_root: bool = False) -> DataFrame:
    """Without the node and everything below it; with ``keep_root`` the node itself stays (clearing a folder)."""
    gone = hierarchy.below(hierarchy.current_nodes(nodes, ["parent_id"]), root_id)
    rest = nodes.join(gone, "id", "left_anti")
    return rest if keep_root else rest.where(~F.col("id").eqNullSafe(F.lit(root_id)))


def delete(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id").distinct(), "id", "left_anti")


def ensure_folders(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """New folder rows (id, parent_id, title) for the pairs (parent_id, title) of ``wanted`` that are not there yet; ids
    come from the pair, so running it twice makes nothing new."""
    have = nodes.where(is_folder()).select("parent_id", "title").distinct()
    new = wanted.select("parent_id", "title").distinct().join(have, ["parent_id", "title"], "left_anti")
    return new.select(F.concat(F.lit("f"), F.lower(F.hex(F.xxhash64("parent_id", "title")))).alias("id"), "parent_id", "title")
