"""Short readings of a period against the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import first_match, index_status


def change(now: str, before: str):  # noqa: ANN201
    return F.when(F.col(before) > 0, (F.col(now) - F.col(before)) * 100.0 / F.col(before)).otherwise(F.when(F.col(now) > 0, 100.0).otherwise(0.0))


def panel(compared: DataFrame, key: str, most: int = 3) -> DataFrame:
    """The ``most`` strongest readings: a click trend, impressions without a place, a move in position."""
    c = F.col
    kind = first_match(
        [
            ((c("previous_clicks") >= 10) & (F.abs(change("clicks", "previous_clicks")) >= 20), "click_trend"),
            ((c("impressions") >= 100) & (c("position") > 3) & (c("clicks") * 50 < c("impressions")), "impressions_opportunity"),
            (F.abs(c("position") - c("previous_position")) >= 1, "position_move"),
        ],
        None,
    )
    rows = compared.withColumn("kind", kind).filter("kind is not null").withColumn("change", F.round(change("clicks", "previous_clicks"), 4))
    return rows.orderBy(F.desc("impressions"), key).limit(most).select(key, "kind", "change")


def index_states(grid: DataFrame, days: int = 30) -> DataFrame:
    return grid.withColumn("index_status", index_status(F.col("coverage_state"), F.col("days_since_crawl")))
