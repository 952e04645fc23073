"""Records that are the same but for white space, letter case, punctuation, escapes and the order of query fields.

Progressive partition refinement. Round 1 groups all rows by cheap invariants (stripped lengths and counts of some
letters, which no reordering of fields changes) with map-side partial counts; classes of one member are settled there.
Round 2 computes the costly key (fields sorted, folded, 128 bits of hash) only for rows of classes with several members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklake.functions.urls import let
from linklake.runtime import Workspace

#: Letters whose counts make up the histogram of round 1.
HISTOGRAM = "aeinorst0123"


def fold(s: Column) -> Column:
    """Letters and digits only, without case (ß is ss, its upper case); null as ''."""
    low = F.replace(F.lower(F.upper(F.coalesce(s, F.lit("")))), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(low, r"[^\p{L}\p{N}]+", "")


def unescaped(s: Column) -> Column:
    """Percent-escapes as the characters they stand for; what is no escape stays."""
    return F.when(~s.contains("%"), s).otherwise(F.coalesce(F.try_url_decode(F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25")), s))


def url_key(url: Column) -> Column:
    """Folded address with its query fields (parted by & or ;) sorted; empty fields and field limits don't count."""

    def build(u: Column) -> Column:
        plain = fold(unescaped(u))
        fields = lambda q: F.array_join(F.array_sort(F.transform(F.split(q, "[&;]"), lambda f: fold(unescaped(f)))), "")
        part = lambda i: F.regexp_extract(u, r"(?s)^([^?#]*)\?([^#]*)(.*)$", i)
        return F.when(~u.rlike(r"\?[^#]*[&;]"), plain).otherwise(F.concat(fold(unescaped(part(1))), let(part(2), fields), fold(unescaped(part(3)))))

    return let(F.coalesce(url, F.lit("")), build)


def copy_key(title: Column, url: Column) -> list[Column]:
    """128 bits over the folded title and the folded address."""

    def both(k: Column) -> Column:
        return F.struct(F.xxhash64(k["t"], k["u"]).alias("k1"), F.xxhash64(F.lit(11), k["u"], k["t"]).alias("k2"))

    return let(F.struct(fold(title).alias("t"), url_key(url).alias("u")), both)


def invariants(title: Column, url: Column) -> Column:
    """64 bits over the stripped lengths and letter histograms of both fields."""

    def count(s: Column) -> list[Column]:
        return [F.length(s), *[F.length(F.replace(s, F.lit(c), F.lit(""))) for c in HISTOGRAM]]

    return let(F.struct(fold(title).alias("t"), fold(unescaped(F.coalesce(url, F.lit("")))).alias("u")), lambda s: F.xxhash64(*count(s["t"]), *count(s["u"])))


def keyed_candidates(df: DataFrame, id_: str = "id", title: str = "title", url: str = "url") -> DataFrame:
    """(id, k1, k2) of the rows whose cheap class has several members; all other rows have no copy.

    A class that holds very many rows is a skewed key only of the semi-join, where adaptive execution splits its rows;
    counts are combined before the shuffle.
    """
    rows = df.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.col(title).alias("t"), F.col(url).alias("u"), invariants(F.col(title), F.col(url)).alias("inv"))
    several = rows.groupBy("inv").agg(F.count("*").alias("n")).where("n > 1").select("inv")
    return rows.join(several, "inv", "left_semi").select("id", copy_key(F.col("t"), F.col("u")).alias("k")).select("id", "k.*")


def copy_links(df: DataFrame) -> DataFrame:
    """(first_id, copy_id): every row of a set of copies but the one with the smallest id, which is first_id.

    Null titles and urls count as empty. Rows with the same id are one row; rows with a null id are left out. Rows that
    are empty in both fields are copies of each other. An empty table gives no rows; other columns are not read.
    """
    keyed = Workspace(df.sparkSession, "copies").put(keyed_candidates(df))
    first = keyed.groupBy("k1", "k2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id").select("k1", "k2", "first_id")
    # a set that holds a third of all rows is a skewed key of the large side only; adaptive execution splits it
    return keyed.join(first, ["k1", "k2"]).where("id <> first_id").select("first_id", F.col("id").alias("copy_id")).distinct()


def collapse(df: DataFrame) -> DataFrame:
    """One record for each set of copies (the row with the smallest id, its columns as they are) with ``n_copies``."""
    links = copy_links(df)
    n = links.groupBy("first_id").agg((F.count("*") + 1).alias("_n"))
    rest = df.join(links.select(F.col("copy_id").alias("_c")), F.col("_c") == df["id"], "left_anti")
    name = "n_copies" if "n_copies" not in df.columns else "n_copies_"
    return rest.join(n, rest["id"] == n["first_id"], "left").drop("first_id").withColumn(name, F.coalesce("_n", F.lit(1))).drop("_n")
