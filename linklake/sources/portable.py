"""Trees and lists in portable forms: nested JSON and bookmark files line by line, import forms, file stamps.

A tree of any size is written as lines with a sort key: sorted by key they are the file, so a tree is spread over range
partitions and is never gathered. ``gathered`` makes one text of each tree and is meant for trees that fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklake.functions import dates, text, urls
from linklake.operators import hierarchy
from linklake.operators.ordering import number_in_group
from linklake.runtime import Workspace, not_blank

#: Sorts behind every key of a descendant.
_LAST = "/\x7f"


def placed(cur: DataFrame) -> DataFrame:
    """A table with unique ids as rows in trees: its columns, root_id, depth, order_key (preorder), place among its
    siblings (from 0, by idx, then id; roots have 0) and has_children. Nodes at cycles are in no tree and left out."""
    ws = Workspace(cur.sparkSession, "placed")
    cur = ws.put(cur)
    key = hierarchy.sibling_key(F.col("idx"), F.col("id"))
    h = ws.put(hierarchy.resolve(cur, key, ws).where("depth >= 0").select("id", "parent", "root_id", "depth", F.array_join("segments", "/").alias("order_key"), F.element_at("segments", -1).alias("own_key")))
    below = number_in_group(h.where("parent is not null").select("id", "parent", "own_key"), ["parent"], ["own_key"]).select("id", "place")
    parents = h.where("parent is not null").select(F.col("parent").alias("id"), F.lit(True).alias("has_children")).distinct()
    return cur.join(h.drop("own_key"), "id").join(below, "id", "left").join(parents, "id", "left").withColumns({"place": F.coalesce("place", F.lit(0)), "has_children": F.coalesce("has_children", F.lit(False))})


def json_lines(rows: DataFrame, fields: list[str] = ["id", "title", "url"]) -> DataFrame:  # noqa: B006
    """(root_id, key, line) of ``placed`` rows: nested JSON {fields..., children: [...]}; null fields are left out."""
    own = F.to_json(F.struct(*fields))
    open_ = F.when(F.col("has_children"), F.concat(F.left(own, F.length(own) - 1), F.lit(',"children":['))).otherwise(own)
    comma = F.when(F.col("place") > 0, ",").otherwise("")
    head = rows.select("root_id", F.col("order_key").alias("key"), F.concat(comma, open_).alias("line"))
    return head.union(rows.where("has_children").select("root_id", F.concat("order_key", F.lit(_LAST)).alias("key"), F.lit("]}").alias("line")))


def html_lines(rows: DataFrame, now_ms: int | None = None) -> DataFrame:
    """(root_id, key, line) of ``placed`` rows as the body of a bookmark file. With ``now_ms`` dates are in seconds,
    missing ones that moment, and folders have LAST_MODIFIED; without it dates are as they stand, missing ones empty."""
    if now_ms is None:
        added, modified = F.coalesce(F.col("date_added").cast("string"), F.lit("")), None
    else:
        added = dates.unix_seconds(F.col("date_added"), now_ms).cast("string")
        modified = dates.unix_seconds(F.col("date_group_modified"), now_ms).cast("string")
    pad = F.repeat(F.lit("    "), F.col("depth") + 1)
    title = text.escape_html(F.coalesce("title", F.lit("")))
    link = F.concat(pad, F.lit('<DT><A HREF="'), text.escape_html(F.col("url")), F.lit('" ADD_DATE="'), added, F.lit('">'), title, F.lit("</A>"))
    stamp = F.concat(F.lit('" LAST_MODIFIED="'), modified) if modified is not None else F.lit("")
    folder = F.concat(pad, F.lit('<DT><H3 ADD_DATE="'), added, stamp, F.lit('">'), title, F.lit("</H3>\n"), pad, F.lit("<DL><p>"))
    is_link = F.coalesce(F.col("url") != "", F.lit(False))
    head = rows.select("root_id", F.col("order_key").alias("key"), F.when(is_link, link).otherwise(folder).alias("line"))
    return head.union(rows.where(~is_link).select("root_id", F.concat("order_key", F.lit(_LAST)).alias("key"), F.concat(pad, F.lit("</DL><p>")).alias("line")))


def gathered(lines: DataFrame, between: str = "\n") -> DataFrame:
    """(root_id, content): one text of each tree."""
    sorted_ = F.array_sort(F.collect_list(F.struct("key", "line")))
    return lines.groupBy("root_id").agg(F.array_join(F.transform(sorted_, lambda x: x["line"]), between).alias("content"))


def parses(s: Column) -> Column:
    """Whether a text is JSON; false for null."""
    return F.try_parse_json(s).isNotNull()


def sniffed(s: Column) -> Column:
    """``html`` for a text that begins with ``<``, ``json`` otherwise; null counts as ''."""
    return F.when(urls.trimmed(F.coalesce(s, F.lit(""))).startswith("<"), "html").otherwise("json")


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def import_nodes(s: Column) -> Column:
    """Array of the nodes in an import text: a list as it is, but a single folder is replaced by its children; a single
    object is a list of itself. Null for text that is no JSON."""

    def unwrap(v: Column) -> Column:
        nodes = F.coalesce(_list(v, "$"), F.when(v.isNotNull(), F.array(v)))
        return urls.let(nodes, lambda n: F.when(F.size(n) == 1, F.coalesce(_list(n[0], "$.children"), n)).otherwise(n))

    return urls.let(F.try_parse_json(s), unwrap)


def import_tabs(s: Column) -> Column:
    """Array of the tabs in an import text: a list, {tabs: [...]} or {windows: [{tabs: [...]}, ...]}; empty for others."""

    def tabs(v: Column) -> Column:
        windows = F.transform(_list(v, "$.windows"), lambda w: F.coalesce(_list(w, "$.tabs"), F.array().cast("array<variant>")))
        return F.coalesce(_list(v, "$"), _list(v, "$.tabs"), F.flatten(windows), F.array().cast("array<variant>"))

    return urls.let(F.try_parse_json(s), tabs)


def with_address(tabs: DataFrame, url: str = "url") -> DataFrame:
    """Rows that have an address."""
    return tabs.where(F.coalesce(F.col(url) != "", F.lit(False)))


def stamp(at: Column) -> Column:
    """``YYYY-MM-DD_HHmmss`` in UTC, for names of files and folders."""
    return F.date_format(at, "yyyy-MM-dd_HHmmss")


def settings(saved: Column, defaults: dict[str, dict]) -> dict[str, Column]:
    """Saved JSON over defaults, section by section: name of each setting -> its value as text."""
    v = F.try_parse_json(saved)
    return {f"{s}.{k}": F.coalesce(F.try_variant_get(v, f"$.{s}.{k}", "string"), F.lit(None if d is None else str(d))) for s, fields in defaults.items() for k, d in fields.items()}


def titled(url: Column, title: Column) -> Column:
    return F.when(not_blank(title), title).otherwise(url)
