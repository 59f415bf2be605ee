"""Dates as columns and, where they decide a plan, as Python values."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_DAYS = 486
UNSTABLE_DAYS = 2


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row for each day of a closed range; none if it is empty."""
    if start > end:
        return spark.createDataFrame([], "date date")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))


def stable_window(as_of: date) -> tuple[date, date]:
    latest = as_of - timedelta(days=UNSTABLE_DAYS)
    return latest - timedelta(days=HISTORY_DAYS - 1), latest


def bucket(day: Column, size: str, week_start: int = 1) -> Column:
    """First day of the bucket: ``day``, ``month``, or ``week`` beginning on ``week_start`` (1: Sunday, 2: Monday)."""
    if size == "week":
        return F.date_sub(day, F.pmod(F.dayofweek(day) - week_start, F.lit(7)))
    return F.trunc(day, "MM") if size == "month" else day


def month_of(day: Column) -> Column:
    return F.trunc(day, "MM")


def provider_date(x: Column) -> Column:
    """``/Date(ms)/``, ISO text, ``yyyyMMdd`` or epoch milliseconds."""
    t = F.trim(x.cast("string"))
    ms = F.regexp_extract(t, r"^/Date\(([-+]?\d+)(?:[-+]\d{4})?\)/$", 1)
    day = lambda n: F.to_date(F.timestamp_millis(n.try_cast("long")))
    return F.coalesce(day(F.nullif(ms, F.lit(""))), F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")).cast("date")), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10).try_cast("date")), F.when(t.rlike(r"^\d{9,}$"), day(t)))


def duration_seconds(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), F.round(end.cast("double") - start.cast("double"))).cast("long")


def age_hours(ts: Column, as_of: Column) -> Column:
    return (as_of.cast("double") - ts.cast("double")) / 3600
