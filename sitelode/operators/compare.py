"""Comparing a period with another: by key, by place in order, by day offset; and crawl with crawl."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_key(now: DataFrame, before: DataFrame, keys: list[str], measures: list[str], how: str = "left") -> DataFrame:
    """Measures of both periods; a key that one lacks counts 0 there. ``full_outer`` keeps the keys of both."""
    old = before.select(*keys, *[F.col(m).alias(f"previous_{m}") for m in measures])
    return now.select(*keys, *measures).join(old, keys, how).fillna(0, [*measures, *(f"previous_{m}" for m in measures)])


def by_place(now: DataFrame, before: DataFrame, day: str, measures: list[str]) -> DataFrame:
    """Series aligned by their place in order of day. Both are series of totals, one row for each day."""
    place = lambda df: df.withColumn("place", F.row_number().over(Window.orderBy(day)))
    old = place(before).select("place", *[F.col(m).alias(f"previous_{m}") for m in measures])
    return place(now).select("place", day, *measures).join(old, "place", "left").fillna(0, [f"previous_{m}" for m in measures])


def by_offset(now: DataFrame, before: DataFrame, day: str, measures: list[str], start: date, end: date, compared_start: date) -> DataFrame:
    """Days of the earlier period move to the day of the later one with the same offset; days beyond its end drop out."""
    moved = F.date_add(F.lit(start), F.datediff(F.col(day), F.lit(compared_start)))
    old = before.select(moved.alias(day), *[F.col(m).alias(f"previous_{m}") for m in measures]).filter(F.col(day).between(start, end))
    return now.select(day, *measures).join(old, day, "full_outer").fillna(0, [*measures, *(f"previous_{m}" for m in measures)])


def crawl_diff(old: DataFrame, new: DataFrame, key: str = "page_key") -> DataFrame:
    """key and change: new, missing, status, title, canonical or unchanged (the first that holds)."""
    fields = ["status_code", "title", "canonical_url"]
    a = old.select(key, F.lit(True).alias("_old"), *[F.col(f).alias(f"old_{f}") for f in fields])
    b = new.select(key, F.lit(True).alias("_new"), *[F.col(f).alias(f"new_{f}") for f in fields])
    differs = lambda f: ~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "missing").when(differs("status_code"), "status").when(differs("title"), "title").when(differs("canonical_url"), "canonical").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def samples(df: DataFrame, group: str, order: str, most: int = 20) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("place") <= most)
