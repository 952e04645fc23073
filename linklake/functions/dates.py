"""Date, number and array expressions. All dates are UTC; reference years are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest epoch value (in ms) that stands for a date.
LAST_MS = 8_640_000_000_000_000


def as_timestamp(ms: Column) -> Column:
    """Timestamp of a positive number of milliseconds; null otherwise."""
    return F.when((ms > 0) & (ms <= 253_402_300_799_999), F.timestamp_millis(ms))


def added_at(value: Column, id_: Column) -> Column:
    """Timestamp of a date in seconds (up to 1e10) or milliseconds; else the id as milliseconds if its year is
    1990 to 2100; null otherwise."""
    ms = F.when(value <= 10_000_000_000, value * 1000).otherwise(value)
    from_id = as_timestamp(id_.try_cast("bigint"))
    good = F.when((ms >= -62_135_596_800_000) & (ms <= 253_402_300_799_999), F.timestamp_millis(ms))
    return F.coalesce(good, F.when(F.year(from_id).between(1990, 2100), from_id))


def date_segments(at: Column, monthly: bool = False) -> Column:
    """[YYYY] or [YYYY, YYYY-MM]; [unknown-date] for null."""
    year = F.date_format(at, "yyyy")
    return F.when(at.isNull(), F.array(F.lit("unknown-date"))).otherwise(F.array(year, F.date_format(at, "yyyy-MM")) if monthly else F.array(year))


def year_bucket(ms: Column, ref_year: int) -> Column:
    """this year, last year, the year, or unknown for null and 0."""
    year = F.year(F.timestamp_millis(F.when((ms != 0) & ms.between(-62_135_596_800_000, 253_402_300_799_999), ms)))
    return F.when(year.isNull(), "unknown").when(year >= ref_year, "this year").when(year == ref_year - 1, "last year").otherwise(year.cast("string"))


def unix_seconds(ms: Column, now_ms: int) -> Column:
    """Whole seconds; the parameter ``now_ms`` stands in for null and 0."""
    return F.floor(F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit(now_ms)).otherwise(ms) / 1000).cast("bigint")


def confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(0.97), 0.45 + 0.05 * score), 2)


def clamp01(v: Column) -> Column:
    """0 to 1; 0.5 for null and NaN."""
    return F.least(F.greatest(F.when(v.isNull() | F.isnan(v.cast("double")), 0.5).otherwise(v.cast("double")), F.lit(0.0)), F.lit(1.0))


def path_array(path: Column) -> Column:
    """Folder names of a path joined by ``/``, blank parts dropped; [] for null."""
    return F.coalesce(F.filter(F.split(path, "/"), lambda p: F.trim(p) != ""), F.array().cast("array<string>"))


def under_root(path: Column, root: list[str]) -> Column:
    """Whether the path begins with all names of ``root``."""
    return F.slice(path, 1, len(root)) == F.array(*map(F.lit, root)) if root else F.lit(True)
