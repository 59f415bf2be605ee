"""Topics: queries with the same tokens, their pages and queries, and an evidence score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import topic_status
from ..functions.measures import clamp, half_up, safe_ratio
from ..functions.text import topic_key


def ranked_list(df: DataFrame, key: str, value: str, order: list, most: int, name: str) -> DataFrame:
    """The first ``most`` values of each key as a list; only those rows are gathered."""
    top = df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_rn") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", value))), lambda x: x[value]).alias(name))


def topics(page_query: DataFrame, crawl: DataFrame, pages: int = 8, queries: int = 10) -> DataFrame:
    """``page_query``: page_key, query, clicks, impressions, position; ``crawl``: page_key, inbound of indexable pages."""
    rows = page_query.filter((F.col("query") != "") & (F.col("page_key") != "") & (F.col("impressions") > 0)).groupBy("page_key", "query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("weight"))
    rows = rows.withColumn("topic", topic_key(F.col("query")))
    by_page = rows.groupBy("topic", "page_key").agg(F.sum("impressions").alias("impressions")).join(crawl, "page_key", "left")
    by_query = rows.groupBy("topic", "query").agg(F.sum("impressions").alias("impressions"))
    label = F.max_by("query", F.struct(F.col("impressions"), F.col("query")))
    total = rows.groupBy("topic").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum("weight").alias("weight"))
    total = total.join(by_query.groupBy("topic").agg(F.count(F.lit(1)).alias("queries"), label.alias("label")), "topic")
    total = total.join(by_page.groupBy("topic").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("inbound"), F.lit(0)).alias("inbound")), "topic")
    order = lambda c: [F.desc("impressions"), F.asc(c)]
    total = total.join(ranked_list(by_page, "topic", "page_key", order("page_key"), pages, "top_pages"), "topic").join(ranked_list(by_query, "topic", "query", order("query"), queries, "top_queries"), "topic")
    total = total.withColumns({"position": safe_ratio(F.col("weight"), F.col("impressions")), "ctr": safe_ratio(F.col("clicks"), F.col("impressions"))})
    points = lambda x, high: half_up(clamp(x, 0, high)).cast("int")
    total = total.withColumns(
        {
            "visibility": points(40 - F.greatest(F.lit(0.0), F.col("position") - 1) * 0.8, 40),
            "demand": points(F.col("ctr") * 250, 25),
            "depth": points(F.col("pages") * 5.0, 20),
            "support": points(F.col("inbound").cast("double"), 15),
            "status": topic_status(F.col("position")),
        }
    )
    issues = [
        F.when(F.col("pages") < 2, "thin"),
        F.when(F.col("position") > 10, "low_position"),
        F.when(F.col("inbound") < F.greatest(F.lit(3), F.col("pages") * 2), "few_links"),
        F.when((F.col("ctr") < 0.02) & (F.col("position") <= 10), "low_ctr"),
    ]
    return total.withColumn("issues", F.filter(F.array(*issues), lambda x: x.isNotNull())).withColumn("score", F.col("visibility") + F.col("demand") + F.col("depth") + F.col("support")).drop("weight")
