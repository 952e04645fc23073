"""Extension: link tables as streams. The batch expressions serve unchanged; state is bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklake.functions import urls


def first_seen(stream: DataFrame, at: str = "loaded_at", delay: str = "1 day") -> DataFrame:
    """The first row of each canonical address within ``delay``; state older than the watermark is dropped."""
    keyed = stream.withColumn("norm", urls.normalize(F.col("url"))).withWatermark(at, delay)
    return keyed.dropDuplicatesWithinWatermark(["norm"])


def arrivals(stream: DataFrame, at: str = "loaded_at", window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """(start, source, n): rows by window of arrival and source, late rows up to ``delay``."""
    by = stream.withWatermark(at, delay).groupBy(F.window(at, window).alias("w"), F.lower(F.trim("source")).alias("source"))
    return by.agg(F.count("*").alias("n")).select("w.start", "source", "n")
