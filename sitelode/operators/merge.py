"""Merging new rows into a stored table, and writing partitions in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """New rows replace old ones of their key; among new rows the first by ``order`` wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, F.col("_new").desc(), *order).drop("_new")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(latest(fresh, keys, *order) if order else fresh.dropDuplicates(keys))


def guarded_upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """As ``upsert`` for one new row per key, but an old row for which ``keep`` holds stays."""
    return old.withColumn("_rank", F.when(keep, 0).otherwise(2)).unionByName(new.withColumn("_rank", F.lit(1))).transform(lambda d: latest(d, keys, F.col("_rank").asc())).drop("_rank")


def widen(old: DataFrame, new: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    return old.select(*keys, low, high).unionByName(new.select(*keys, low, high)).groupBy(*keys).agg(F.min(low).alias(low), F.max(high).alias(high))


def count_uses(cache: DataFrame, hits: DataFrame, keys: list[str], counter: str = "use_count") -> DataFrame:
    """Adds the number of hits to each cached row; hits that are not cached are dropped."""
    n = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hits"))
    return cache.join(n, keys, "left").withColumn(counter, F.col(counter) + F.coalesce("_hits", F.lit(0))).drop("_hits")


def replace_partitions(df: DataFrame, path: str, by: str = "date") -> None:
    """Writes the partitions that ``df`` has and leaves the others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def merge_touched(new: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], by: str = "date") -> list:
    """Merges ``new`` into the table at ``path``, partitioned by ``by``, reading and writing only the partitions that
    ``new`` touches, which it returns. ``merge`` is any of the merges above as a function of old and new rows; the keys must
    include ``by``. The merged rows are staged first, since they come from the files that they replace; files of other
    partitions stay as they are. A partition that becomes empty stays."""
    spark = new.sparkSession
    fresh = stored(new, "merge-new")
    touched = sorted(r[0] for r in fresh.select(by).distinct().collect())  # partitions, not rows
    if touched:
        old = spark.read.schema(new.schema).parquet(path).filter(F.col(by).isin(touched))
        replace_partitions(stored(merge(old.select(new.columns), fresh), "merged"), path, by)
    return touched


def rollup_pages(page_query: DataFrame) -> DataFrame:
    """Page facts from page and query facts, on the key."""
    position = F.sum(F.col("position") * F.col("impressions"))
    total = F.sum("impressions")
    return page_query.filter("page_key <> ''").groupBy("date", "page_key").agg(F.sum("clicks").alias("clicks"), total.alias("impressions"), F.when(total > 0, position / total).otherwise(0.0).alias("position"), F.count_distinct(F.nullif("query", F.lit(""))).alias("query_count"))


def split_valid(rows: DataFrame, keys: int) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of provider rows."""
    return rows.filter(valid_row(keys)), rows.filter(~valid_row(keys))


def valid_row(keys: int) -> Column:
    """True for a provider row with enough keys and four numbers."""
    ok = (F.size("keys") >= keys) & F.col("clicks").isNotNull() & F.col("impressions").isNotNull() & F.col("ctr").isNotNull() & F.col("position").isNotNull()
    return F.coalesce(ok, F.lit(False))
