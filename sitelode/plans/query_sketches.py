"""Distinct queries over long ranges from stored sketches.

A distinct count over months cannot be added up from monthly ones. The summary therefore keeps, for each month and key, a
HyperLogLog sketch of its queries beside the additive sums; a range unites the sketches of its full months with those of its
edge days, so no raw row of a full month is read. With 2^LOG_SIZE registers the relative standard error is
1.04 / sqrt(2^LOG_SIZE), 0.8 percent; up to a few hundred queries the sketch keeps them apart and the count is exact but for
hash clashes. The exact count over raw rows stays beside it (``SearchReport`` with ``query_count``).
"""

from __future__ import annotations

import math
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import safe_ratio
from .summary_window import month_end, summary_window

LOG_SIZE = 14
#: Three standard errors.
MOST_ERROR = 3 * 1.04 / math.sqrt(1 << LOG_SIZE)


def _additive(days: DataFrame, keys: list[str]) -> DataFrame:
    return days.groupBy(*keys).agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.sum(F.col("position") * F.col("impressions")).alias("position_sum"),
        F.count_distinct(F.struct("date", "query")).alias("query_days"),
        F.hll_sketch_agg("query", F.lit(LOG_SIZE)).alias("queries"),
    )


def sketched_summary(daily: DataFrame, keys: list[str], start: date | None = None, end: date | None = None, tasks: int | None = None) -> DataFrame:
    """Sums, query_days and the sketch of the queries by month and ``keys``, from rows with a query; whole months only.
    ``tasks``: how many tasks the rows are dealt to once, by month and a hash range of the keys, so that a table
    partitioned by month gets one file for each of these; else, as the rows lie."""
    days = daily.filter("query <> ''")
    if start is not None:
        days = days.filter(F.col("date") >= start.replace(day=1))
    if end is not None:
        days = days.filter(F.col("date") <= month_end(end))
    days = days.withColumn("month_start", F.trunc("date", "MM"))
    if tasks is None:
        return _additive(days, ["month_start", *keys])
    # About as many ranges in a month as make several for each task from a few years.
    dealt = days.withColumn("_range", F.pmod(F.hash(*keys), F.lit(1 + tasks // 16))).repartition(tasks, "month_start", "_range")
    return _additive(dealt, ["month_start", "_range", *keys]).drop("_range")


def report(daily: DataFrame, summary: DataFrame, start: date, end: date, keys: list[str]) -> DataFrame:
    """Sums, ctr, position, query_days and query_count (estimated) by ``keys`` over the range: full months from the summary,
    edge days from rows."""
    window = summary_window(start, end)
    days = daily.filter("query <> ''")
    if window is None:
        parts = _additive(days.filter(F.col("date").between(start, end)), keys)
    else:
        edges = reduce(lambda a, b: a | b, [F.col("date").between(a, b) for a, b in window.edges], F.lit(False))
        months = summary.filter(F.col("month_start").between(window.first, window.last)).drop("month_start")
        parts = months.unionByName(_additive(days.filter(edges), keys)) if window.edges else months
    sums = [F.sum(c).alias(c) for c in ("clicks", "impressions", "position_sum", "query_days")]
    total = parts.groupBy(*keys).agg(*sums, F.hll_sketch_estimate(F.hll_union_agg("queries")).alias("query_count"))
    return total.withColumns({"ctr": safe_ratio(F.col("clicks"), F.col("impressions")), "position": safe_ratio(F.col("position_sum"), F.col("impressions"))}).drop("position_sum")
