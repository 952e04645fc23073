"""Link states from recorded or live probe responses. A probe is a provider: a callable from an iterator of canonical
addresses to response rows; the default reads a table of recorded responses, so that tests need no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklake.functions import urls

STATES = ["ok", "redirect", "broken", "blocked", "server_error", "timeout", "empty", "invalid", "unsupported"]
# What a report shows for a state: bucket and label. States that are missing here are no faults.
REPORTED = {"empty": ("empty", "空链接"), "invalid": ("invalid", "无效URL"), "unsupported": ("invalid", "无效URL"), "timeout": ("timeout", "超时"), "blocked": ("status", "访问受限"), "broken": ("status", "状态码异常"), "server_error": ("status", "状态码异常")}
RESPONSE = "norm string, head_status int, get_status int, retry_status int, final_url string"


def state_of(status: Column) -> Column:
    """2xx ok, 3xx redirect, 401/403/429 blocked, other 4xx broken, 5xx server_error, anything else broken; null is a
    timeout."""
    return (
        F.when(status.isNull(), "timeout").when(status.between(200, 299), "ok").when(status.between(300, 399), "redirect")
        .when(status.isin(401, 403, 429), "blocked").when(status.between(500, 599), "server_error").otherwise("broken")
    )


def settled_status(head: Column, get: Column, retry: Column, retries: int = 1) -> Column:
    """The status that counts: GET where HEAD failed (-1) or isn't supported (400, 403, 405, 406, 501), then one retry
    of a 5xx. A null HEAD is an abort, after which no GET is sent."""
    first = F.when(head.isin(-1, 400, 403, 405, 406, 501), get).otherwise(head)
    return F.when(first.between(500, 599) & F.lit(retries > 0), F.coalesce(retry, first)).otherwise(first)


def check(df: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, status, http_status, final_url): each distinct address is looked up once and fanned out to its rows.
    Addresses without a response count as a timeout."""
    rows = df.where("id is not null").select("id", urls.classify(F.col("url"))["kind"].alias("kind"), urls.normalize(F.col("url")).alias("norm"))
    r = responses.withColumn("http_status", settled_status(F.col("head_status"), F.col("get_status"), F.col("retry_status"))).select("norm", "http_status", "final_url")
    j = rows.join(r, "norm", "left")
    state = state_of(F.col("http_status"))
    moved = (state == "ok") & F.col("final_url").isNotNull() & (F.col("final_url") != F.col("norm"))
    status = F.when(F.col("kind") == "empty", "empty").when(F.col("kind") == "invalid", "invalid").when(F.col("kind") == "other", "unsupported").when(moved, "redirect").otherwise(state)
    web = F.col("kind") == "http"
    return j.select("id", status.alias("status"), F.when(web, F.col("http_status")).alias("http_status"), F.when(web, F.coalesce("final_url", "norm")).alias("final_url"))


def probe(df: DataFrame, provider: Callable[[Iterator[str]], Iterator[tuple]]) -> DataFrame:
    """Response rows of all distinct http(s) addresses, those of one host in one task so that a provider can keep to its
    rate. A host beyond a task's share is split by address, ``spark.sql.shuffle.partitions`` ways."""
    norm = df.where(urls.classify(F.col("url"))["kind"] == "http").select(urls.normalize(F.col("url")).alias("norm")).distinct()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    big = norm.groupBy(urls.host(F.col("norm")).alias("h")).agg(F.count("*").alias("k"))
    share = max(1, norm.count() // n)
    keyed = norm.withColumn("h", urls.host(F.col("norm"))).join(big, "h").withColumn("salt", F.when(F.col("k") > share, F.pmod(F.xxhash64("norm"), F.lit(n))).otherwise(0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(list(provider(iter(b["norm"]))), columns=["norm", "head_status", "get_status", "retry_status", "final_url"])

    return keyed.repartition("h", "salt").select("norm").mapInPandas(run, RESPONSE)


def summary(checked: DataFrame) -> DataFrame:
    """One row: a counter for each state, total and skipped."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return checked.agg(*map(n, STATES), F.count("*").alias("total"), F.count_if(F.col("status").isin("empty", "invalid", "unsupported")).alias("skipped"))


def reported(checked: DataFrame, include: list[str] | None = None) -> DataFrame:
    """(id, bucket, label) of the links that a report shows, of the buckets ``include`` only if given."""
    both = None
    for state, (bucket, name) in REPORTED.items():
        value = F.struct(F.lit(bucket).alias("bucket"), F.lit(name).alias("label"))
        both = F.when(F.col("status") == state, value) if both is None else both.when(F.col("status") == state, value)
    out = checked.select("id", both.alias("b")).where("b is not null").select("id", "b.bucket", "b.label")
    return out if include is None else out.where(F.col("bucket").isin(include))


def by_label(report: DataFrame) -> DataFrame:
    """(label, n) of a report, largest first."""
    return report.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def plainly_valid(head: Column, get: Column) -> Column:
    """Whether a plain probe succeeds: HEAD below 400, else GET below 400; null and -1 are failures."""
    ok = lambda c: F.coalesce((c > 0) & (c < 400), F.lit(False))
    return ok(head) | ok(get)


def validated(found: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, valid): rows of a search with the outcome of a plain probe; addresses without a response are not valid."""
    keyed = found.select("id", urls.normalize(F.col("url")).alias("norm"))
    return keyed.join(responses.select("norm", "head_status", "get_status"), "norm", "left").select("id", plainly_valid(F.col("head_status"), F.col("get_status")).alias("valid"))
