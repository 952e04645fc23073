"""Search, filters and paging over bookmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklake.functions import dates, text
from linklake.operators.ordering import number_in_group


def search(df: DataFrame, query: str, ignore_case: bool = True) -> DataFrame:
    """Rows whose title or url contains the text; null counts as ''. An empty query finds everything."""
    c = lambda n: F.coalesce(F.lower(n) if ignore_case else F.col(n), F.lit(""))
    q = F.lit(query.lower() if ignore_case else query)
    return df.where(F.contains(c("title"), q) | F.contains(c("url"), q))


def any_keyword(df: DataFrame, terms: str) -> DataFrame:
    """Rows whose title and url together contain any term of a list parted by blanks or commas; none for no terms."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))))
    return df.where(F.exists(text.keywords(F.lit(terms)), lambda t: F.contains(hay, t)))


def outside(df: DataFrame, folder: str) -> DataFrame:
    """Rows with an address whose path doesn't hold the folder name."""
    return df.where(F.coalesce(F.col("url") != "", F.lit(False)) & ~F.array_contains(dates.path_array(F.col("path")), folder))


def page(df: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """Page ``number`` (from 1, clamped to the last) of the ordered rows: a distributed sort and one limit, for a page
    that is shown to someone."""
    last = max(1, -(-df.count() // size))
    number = min(max(1, number), last)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def chunked(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``df`` with ``chunk``: fixed-size slices of the whole order, numbered without a single-task window."""
    n = number_in_group(df.withColumn("_all", F.lit(1)), ["_all"], order, "_n")
    return n.withColumn("chunk", F.floor(F.col("_n") / size)).drop("_n", "_all")
