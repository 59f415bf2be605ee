"""The search report: any of date, query, page and country, under filters, from the coarsest grain that can answer.

A plan is built lazily. Without a date dimension, a range of LEAST_DAYS days or more reads full months from the summary of
its grain and only the edges from daily facts; sums of positions are stored, so both routes give the same means.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import page_key
from ..functions.measures import safe_ratio
from ..operators.paging import Placed, after, ordered, paged, place
from .summary_window import month_end, summary_window

DIMENSIONS = ("date", "query", "page", "country")
COLUMN = {"date": "date", "query": "query", "page": "page_key", "country": "country"}
MOST_ROWS, MOST_OFFSET = 50_000, 1_000_000
#: Dimensions that each grain has, coarsest first.
GRAINS = {"site_daily": {"date"}, "country_daily": {"date", "country"}, "page_daily": {"date", "page"}, "query_daily": {"date", "query"}, "page_query_daily": {"date", "page", "query"}}


class UnsupportedShape(ValueError):
    """No grain has all the dimensions that are asked for."""


@dataclass(frozen=True)
class Filter:
    dimension: str
    operator: str
    expression: str


@dataclass(frozen=True)
class SearchReport:
    start: date
    end: date
    dimensions: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    limit: int = 1000
    offset: int = 0
    query_metric: bool = False
    #: With a site, facts must have the columns owner and site; an owner of None finds the rows without one.
    site: str | None = None
    owner: str | None = None

    def __post_init__(self) -> None:
        if self.start > self.end:
            raise ValueError("the range ends before it starts")
        if not 1 <= self.limit <= MOST_ROWS or not 0 <= self.offset <= MOST_OFFSET:
            raise ValueError("limit or offset out of bounds")
        if set(self.dimensions) - set(DIMENSIONS) or len(set(self.dimensions)) != len(self.dimensions):
            raise ValueError(f"dimensions {self.dimensions}")

    @property
    def grain(self) -> str:
        """The coarsest grain that has every dimension that is shown or filtered."""
        needed = {"date", *self.dimensions, *(f.dimension for f in self.filters if _known(f))}
        for name, has in GRAINS.items():
            if needed <= has and not (self.query_metric and name == "country_daily"):
                return name
        raise UnsupportedShape(f"no grain has {sorted(needed)}")

    def predicate(self) -> Column:
        """Filters with an unknown operator or dimension are ignored; page literals are compared as keys."""
        own = GRAINS[self.grain] - {"date"}
        parts = [F.col(COLUMN[d]) != "" for d in own]
        if self.site is not None:
            parts += [F.col("site") == self.site, F.col("owner").eqNullSafe(F.lit(self.owner).cast("string"))]
        for f in filter(_known, self.filters):
            c = F.col(COLUMN[f.dimension])
            if f.operator == "equals":
                parts.append(c == (page_key(F.lit(f.expression)) if f.dimension == "page" else F.lit(f.expression)))
            else:
                parts.append(c.contains(f.expression) if f.operator == "contains" else ~c.contains(f.expression))
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def plan(self, facts: Mapping[str, DataFrame], summaries: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """All rows of the report, before order and paging. ``summaries`` by the daily grain's name."""
        grain = self.grain
        daily = facts[grain].filter(F.col("date").between(self.start, self.end)).filter(self.predicate())
        window = None if "date" in self.dimensions or not summaries or grain not in summaries else summary_window(self.start, self.end)
        additive = self._additive(daily)
        if window is not None:
            edges = reduce(lambda a, b: a | b, [F.col("date").between(a, b) for a, b in window.edges], F.lit(False))
            months = summaries[grain].filter(F.col("month_start").between(window.first, window.last)).filter(self.predicate())
            additive = self._additive(daily.filter(edges)).unionByName(self._additive(months))
        keys = [COLUMN[d] for d in self.dimensions]
        total = additive.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in additive.columns if c not in keys and c != "query"], *self._queries(additive))
        return total.withColumn("ctr", safe_ratio(F.col("clicks"), F.col("impressions"))).withColumn("position", safe_ratio(F.col("position_sum"), F.col("impressions"))).drop("position_sum")

    def _additive(self, df: DataFrame) -> DataFrame:
        sums = F.col("position_sum") if "position_sum" in df.columns else F.col("position") * F.col("impressions")
        extra = [c for c in ("query_days",) if c in df.columns] or ([F.col("query_count").alias("query_days")] if "query_count" in df.columns else [])
        keys = dict.fromkeys([*(COLUMN[d] for d in self.dimensions), *(["query"] if self._distinct(df) else [])])
        return df.select(*keys, "clicks", "impressions", sums.alias("position_sum"), *extra)

    def _distinct(self, df: DataFrame) -> bool:
        return "query" in df.columns and "query" not in self.dimensions

    def _queries(self, df: DataFrame) -> list[Column]:
        return [F.count_distinct(F.nullif("query", F.lit(""))).alias("query_count")] if self._distinct(df) else []

    def order(self) -> list[tuple[str, bool]]:
        """Columns of the order, and whether they descend."""
        keys = [(COLUMN[d], False) for d in self.dimensions]
        if "date" in self.dimensions:
            return [("date", False), *(k for k in keys if k[0] != "date")]
        return [("clicks", True), ("impressions", True), *keys] if self.dimensions else [("impressions", True)]

    def page(self, facts: Mapping[str, DataFrame], summaries: Mapping[str, DataFrame] | None = None) -> DataFrame:
        return paged(self.plan(facts, summaries), ordered(self.order()), self.limit, self.offset)

    def placed(self, facts: Mapping[str, DataFrame], summaries: Mapping[str, DataFrame] | None = None) -> Placed:
        """The whole report in buckets of its order, for many pages."""
        return place(self.plan(facts, summaries), ordered(self.order()))

    def after(self, last: tuple, facts: Mapping[str, DataFrame], summaries: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """The page behind the row whose values in the columns of ``order`` are ``last``."""
        return after(self.plan(facts, summaries), self.order(), last, self.limit)

    def total(self, facts: Mapping[str, DataFrame], summaries: Mapping[str, DataFrame] | None = None) -> int:
        return self.plan(facts, summaries).count()


def _known(f: Filter) -> bool:
    return f.dimension in ("query", "page", "country") and f.operator in ("equals", "contains", "notContains")


def monthly_summary(daily: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Sums by month and the daily grain's keys; only whole months of the range, so that a short refresh never leaves half a month."""
    keys = [c for c in ("page_key", "query", "country") if c in daily.columns]
    days = daily.filter(reduce(lambda a, b: a & b, [F.col(k) != "" for k in keys], F.lit(True)))
    keys = [*(c for c in ("owner", "site") if c in daily.columns), *keys]
    if start is not None:
        days = days.filter(F.col("date") >= start.replace(day=1))
    if end is not None:
        days = days.filter(F.col("date") <= month_end(end))
    extra = [F.sum("query_count").alias("query_days")] if "query_count" in daily.columns else []
    return days.groupBy(F.trunc("date", "MM").alias("month_start"), *keys).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("position_sum"), *extra)


def months_covered(summary: DataFrame, start: date, end: date) -> bool:
    """True if every full month of the range has a row."""
    window = summary_window(start, end)
    if window is None:
        return False
    return summary.filter(F.col("month_start").between(window.first, window.last)).select("month_start").distinct().count() == len(window.months)
