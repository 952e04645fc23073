"""Netscape bookmark files: tolerant reading into rows, and writing back.

Reading is a Python table function per file (a stateful grammar that relational operators can't express); files are
independent, so it scales with their number. Writing sorts lines by a path key in the cluster and concatenates them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linklake.functions import text
from linklake.functions.urls import trimmed

RECORD = "file string, ord bigint, title string, url string, path array<string>, add_date double, icon string"
# comment, CDATA, tag (quotes may hold >), text; what is left unclosed at the end matches nothing and ends the scan
_TOKEN = re.compile(r"""<!--(?:.*?)-->|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?!!--)(?P<tag>(?:[^>"']|"[^"]*"|'[^']*')*)>|(?P<text>[^<]+)""", re.S | re.I)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# The entities that are decoded besides numeric ones.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–", "middot": "·"}
_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z]+);")


def decode(s: str) -> str:
    """Numeric entities and the named ones of ``ENTITIES``; unknown ones stay."""
    return _ENTITY.sub(lambda m: unescape(m[0]) if m[1][0] == "#" else ENTITIES.get(m[1].lower(), m[0]), s)


def attributes(source: str) -> dict[str, str]:
    """Names in lower case, values decoded and without quotes; a bare name has the value ''. The first of a name counts."""
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        if value[:1] in "\"'" and value:
            value = value[1:-1]
        out.setdefault(name.lower(), decode(value))
    return out


class _Reader:
    def __init__(self) -> None:
        self.path: list[str] = []
        self.lists: list[bool] = []
        self.folder: str | None = None
        self.open: tuple[str, dict] | None = None
        self.buffer: list[str] = []
        self.out: list[tuple] = []

    def close(self) -> None:
        """Ends an open anchor or folder title."""
        if not self.open:
            return
        (kind, attrs), self.open = self.open, None
        label, self.buffer = decode("".join(self.buffer)), []
        if kind == "h3":
            self.folder = label.strip()
            return
        url = attrs.get("href", "").strip()
        if url:
            stamp = attrs.get("add_date", attrs.get("adddate", "")).strip()
            number = float(stamp) if re.fullmatch(r"[+-]?\d+(\.\d+)?", stamp) else None
            icon = attrs.get("icon", attrs.get("icon_uri", ""))
            self.out.append((" ".join(label.split()), url, list(self.path), number, icon if icon.strip() else None))

    def tag(self, body: str) -> None:
        name = re.match(r"\s*(/?)\s*([^\s/]*)", body)
        kind, ending = name[2].lower(), bool(name[1])
        if kind not in ("a", "h3", "dl", "dt"):
            return
        if ending and kind in ("a", "h3"):
            if self.open and self.open[0] == kind:
                self.close()
            return
        self.close()
        if kind in ("a", "h3"):
            self.open = kind, attributes(body[name.end() :]) if kind == "a" else {}
        elif kind == "dl" and not ending:
            self.lists.append(self.folder is not None)
            if self.folder is not None:
                self.path.append(self.folder)
            self.folder = None
        else:
            if kind == "dl" and self.lists and self.lists.pop():
                self.path.pop()
            self.folder = None


def parse(html: str | None) -> list[tuple]:
    """(title, url, path, add_date, icon) of every anchor with an address, in order. Nothing raises: a comment or tag
    that never closes ends the scan, an anchor open at the end counts."""
    r, at, s = _Reader(), 0, (html or "").removeprefix("﻿")
    while m := _TOKEN.match(s, at):
        at = m.end()
        if m["tag"] is not None:
            r.tag(m["tag"])
        elif r.open and (m["text"] or m["cdata"]):
            r.buffer.append(m["text"] or m["cdata"])
    r.close() if r.open and r.open[0] == "a" else None
    return r.out


def records(files: DataFrame, name: str = "file", content: str = "content") -> DataFrame:
    """Rows of ``RECORD`` from a table of files (name, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, i, *rec) for f, c in zip(b.iloc[:, 0], b.iloc[:, 1]) for i, rec in enumerate(parse(c))]
            yield pd.DataFrame(rows, columns=["file", "ord", "title", "url", "path", "add_date", "icon"])

    return files.select(name, content).mapInPandas(run, RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    return records(files)


HEAD = ["<!DOCTYPE NETSCAPE-Bookmark-file-1>", '<META HTTP-EQUIV="Content-Type" CONTENT="text/html; charset=UTF-8">', "<TITLE>Bookmarks</TITLE>", "<H1>Bookmarks</H1>", "<DL><p>"]


def lines(recs: DataFrame) -> DataFrame:
    """(key, line) of the body of one file: per folder its links first, then its folders in first-seen order. ``recs``
    has ord, title, url, path, add_date, icon. Sorted by key the lines are the file; write them with ``write``."""
    pad = lambda n: F.lpad(n.cast("string"), 12, "0")
    folders = recs.where("size(path) > 0").select("ord", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("p"))
    first = folders.groupBy("p").agg(F.min("ord").alias("first"))
    # the key of a folder is the chain of its ancestors' first places
    chain = first.select("p", "first", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice("p", F.lit(1), i))).alias("level", "up"))
    keyed = chain.join(first.select(F.col("p").alias("up"), F.col("first").alias("place")), "up").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("level", "place"))).alias("c"))
    folder_key = keyed.select("p", F.array_join(F.transform("c", lambda x: F.concat(F.lit("2"), pad(x["place"]))), "").alias("key"))
    indent = lambda n: F.repeat(F.lit("    "), n)
    opening = folder_key.select("key", F.concat(indent(F.size("p")), F.lit("<DT><H3>"), text.escape_html(F.element_at("p", -1)), F.lit("</H3>\n"), indent(F.size("p")), F.lit("<DL><p>")).alias("line"))
    closing = folder_key.select(F.concat("key", F.lit("3")).alias("key"), F.concat(indent(F.size("p")), F.lit("</DL><p>")).alias("line"))
    number = F.when(F.col("add_date") == F.floor("add_date"), F.col("add_date").cast("bigint").cast("string")).otherwise(F.regexp_replace(F.col("add_date").cast("decimal(30,6)").cast("string"), "0+$", ""))
    attr = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), text.escape_html(c), F.lit('"')), F.lit(""))
    link = F.concat(indent(F.size("path") + 1), F.lit('<DT><A HREF="'), text.escape_html(F.coalesce("url", F.lit(""))), F.lit('"'), attr("ADD_DATE", number), attr("ICON", F.col("icon")), F.lit(">"), text.escape_html(F.coalesce("title", F.lit(""))), F.lit("</A>"))
    links = recs.join(folder_key.withColumnRenamed("p", "path"), "path", "left").select(F.concat(F.coalesce("key", F.lit("")), F.lit("1"), pad(F.col("ord"))).alias("key"), link.alias("line"))
    return opening.unionByName(closing).unionByName(links)


def write(recs: DataFrame, path: str) -> None:
    """One text file a range partition, in order: part files read one after the other are the bookmark file."""
    spark = recs.sparkSession
    head = spark.createDataFrame([("", "\n".join(HEAD)), ("~", "</DL><p>")], "key string, line string")
    lines(recs).unionByName(head).orderBy("key").select("line").write.mode("overwrite").text(path)


def envelope(data: Column, exported_at: str, schema: str = "linklake.backup", version: int = 2) -> Column:
    """JSON text of a versioned backup around ``data``."""
    return F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit(version).alias("version"), F.lit(exported_at).alias("exportedAt"), data.alias("data")), {"pretty": "true"})


def export_name(raw: Column, extension: str, fallback: str) -> Column:
    """A file name without characters illegal in paths and with the right extension."""
    n = trimmed(F.regexp_replace(F.coalesce(F.nullif(trimmed(raw), F.lit("")), F.lit(fallback)), r'[\\/:*?"<>|]+', "-"))
    return F.when(F.lower(n).endswith(extension), n).otherwise(F.concat(F.regexp_replace(n, r"(?i)\.(json|html)$", ""), F.lit(extension)))
