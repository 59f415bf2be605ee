"""Completeness: which days of a range are stored, which are missing, and in what chunks to fetch them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import calendar, stable_window
from ..functions.measures import safe_ratio

COVERED = ("complete", "partial", "zero")
#: Days fetched at once by kind of data.
CHUNK_DAYS = {"core": 120, "pages": 7, "dimensions": 120, "llm": 120}


def day_status(ledger: DataFrame, stored: DataFrame, start: date, end: date, least: int = 1) -> DataFrame:
    """date, status. The ledger decides where it says complete, partial or zero; stored rows come next, its errors last."""
    days = calendar(stored.sparkSession, start, end)
    noted = ledger.groupBy("date").agg(F.max(F.when(F.col("status").isin(*COVERED), F.col("status"))).alias("_good"), F.max(F.when(F.col("status") == "error", F.lit(True))).alias("_error"))
    counted = stored.groupBy("date").agg(F.count(F.lit(1)).alias("_rows"))
    status = F.coalesce("_good", F.when(F.col("_rows") >= least, "complete"), F.when(F.col("_error"), "error"), F.lit("missing"))
    return days.join(noted, "date", "left").join(counted, "date", "left").select("date", status.alias("status"))


def dataset_status(ledger: DataFrame, required: int) -> DataFrame:
    """date, status of a group of datasets: all must be stored; partial if any is, zero if all are."""
    good = ledger.filter(F.col("status").isin(*COVERED))
    n = F.count_distinct("dataset")
    partial = F.max((F.col("status") == "partial") | F.coalesce("truncated", F.lit(False)))
    status = F.when(n < required, "missing").when(partial, "partial").when(F.count_if(F.col("status") == "zero") == F.count(F.lit(1)), "zero").otherwise("complete")
    return good.groupBy("date").agg(status.alias("status"))


def by_dataset(stored: DataFrame, datasets: list[str], start: date, end: date) -> DataFrame:
    """Of each dataset: expected and covered days, the covered share, first and last stored day. ``stored``: dataset, date."""
    days = calendar(stored.sparkSession, start, end).select("date", F.explode(F.array(*map(F.lit, datasets))).alias("dataset"))
    held = stored.select("dataset", "date").distinct().withColumn("_here", F.lit(True))
    covered = F.count("_here")
    return days.join(held, ["dataset", "date"], "left").groupBy("dataset").agg(F.count(F.lit(1)).alias("expected"), covered.alias("covered"), safe_ratio(covered, F.count(F.lit(1))).alias("ratio"), F.min(F.when(F.col("_here"), F.col("date"))).alias("first_day"), F.max(F.when(F.col("_here"), F.col("date"))).alias("last_day"))


def summary(days: DataFrame, most_missing: int = 31) -> DataFrame:
    """One row: counts, the covered share, and the first missing days."""
    covered = F.count_if(F.col("status").isin(*COVERED))
    missing = F.slice(F.sort_array(F.collect_list(F.when(~F.col("status").isin(*COVERED), F.col("date")))), 1, most_missing)
    return days.agg(F.count(F.lit(1)).alias("expected"), covered.alias("covered"), F.count_if(F.col("status") == "error").alias("errors"), safe_ratio(covered, F.count(F.lit(1))).alias("ratio"), missing.alias("missing_dates"))


def fetchable(start: date, end: date, as_of: date, property_start: date | None = None) -> tuple[date, date] | None:
    """The part of a range that a provider can answer; None if there is none."""
    first, last = stable_window(as_of)
    low, high = max(start, first, property_start or first), min(end, last)
    return (low, high) if low <= high else None


def missing_chunks(days: DataFrame, chunk: int) -> DataFrame:
    """chunk, start, end, days: the sorted missing days in runs of ``chunk``; a run may span covered days between them.

    ``days`` is a calendar: one row for each day of a range, so that it is bounded."""
    missing = days.filter(~F.col("status").isin(*COVERED))
    numbered = missing.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy("date")) - 1) / chunk).cast("long"))
    return numbered.groupBy("chunk").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("days"))


def islands(days: DataFrame, keys: list[str], day: str = "date") -> DataFrame:
    """Runs of days without a gap, by key."""
    ordered = days.select(*keys, day).distinct().withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(day)))
    run = ordered.withColumn("_run", F.expr(f"date_sub({day}, _rn)"))
    return run.groupBy(*keys, "_run").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count(F.lit(1)).alias("days")).drop("_run")


def gaps(days: DataFrame, keys: list[str], day: str = "date") -> DataFrame:
    """Closed ranges between a key's first and last day in which it has none."""
    after = F.lead(day).over(Window.partitionBy(*keys).orderBy(day))
    return days.select(*keys, day).distinct().withColumn("_next", after).filter(F.datediff("_next", day) > 1).select(*keys, F.date_add(day, 1).alias("start"), F.date_sub("_next", 1).alias("end"))


def chunked(start: date, end: date, days: int) -> list[tuple[date, date]]:
    out = []
    while start <= end:
        stop = min(end, start + timedelta(days=days - 1))
        out.append((start, stop))
        start = stop + timedelta(days=1)
    return out
