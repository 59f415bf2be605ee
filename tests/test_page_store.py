"""The page store: what it reads, how it is planned; distinct queries from sketches."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from sitelode import catalog_queries, report_queries
from sitelode.operators import blend, graph
from sitelode.plans import query_sketches
from sitelode.shared import small_parts
from sitelode.sources.page_store import PageStore
from sitelode.standins import fact

START, END, CRAWLED = date(1996, 1, 15), date(1996, 4, 20), date(1996, 5, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def facts(spark):
    search = [("o1", "a", date(1996, 1, 10), "/x", "q1", 5, 10, 2.0), ("o1", "a", date(1996, 1, 15), "/x", "q1", 1, 10, 2.0), ("o1", "a", date(1996, 2, 1), "/x", "q2", 2, 30, 4.0), ("o1", "a", date(1996, 2, 1), "/only", "q2", 2, 0, 4.0), (None, "a", date(1996, 2, 1), "/x", "q9", 7, 7, 1.0), ("o1", "b", date(1996, 2, 1), "/x", "q9", 7, 7, 1.0), ("o1", "a", date(1996, 2, 1), "", "q9", 7, 7, 1.0)]
    traffic = [("o1", "a", date(1996, 3, 1), "/x", 4, 8, 0.5), ("o1", "a", date(1996, 4, 20), "/raw", 2, 3, 1.0), ("o1", "a", date(1996, 4, 21), "/late", 2, 3, 1.0), ("o1", "b", date(1996, 4, 1), "/x", 2, 3, 1.0)]
    pages = [("o1", "a", "https://a.example/x", None, 200, False, "T", "D", 1, 1), ("o1", "a", "https://a.example/raw", "https://a.example/x", 404, False, "", "", 0, 2), ("o1", "a", "https://a.example/raw2", "https://a.example/gone", 200, True, "", "", 2, 3), ("o1", "b", "https://b.example/x", None, 500, False, "T", "D", 1, 4)]
    links = [("/x", "/raw"), ("/only", "/raw"), ("/raw", "/x"), ("/x", "/x")]
    return (
        spark.createDataFrame(search, "owner string, site string, date date, page_key string, query string, clicks long, impressions long, position double"),
        spark.createDataFrame(traffic, "owner string, site string, date date, page_key string, sessions long, page_views long, bounce_rate double"),
        spark.createDataFrame(pages, "owner string, site string, url string, canonical_url string, status_code int, noindex boolean, title string, meta_description string, h1_count int, crawl_order long"),
        graph.inbound(spark.createDataFrame(links, "from_key string, to_key string")),
    )


@pytest.fixture(scope="module")
def store(spark, facts):
    search, traffic, pages, inbound = facts
    made = PageStore(spark, 3).add_search(search).add_traffic(traffic).add_crawl(pages, inbound, "https://a.example", CRAWLED)
    yield made
    made.drop()


def test_sides_are_the_full_outer_join(store, facts):
    search, traffic, pages, inbound = facts
    mine = lambda d: d.filter("owner = 'o1' and site = 'a'")
    within = lambda d: mine(d).filter(F.col("date").between(START, END))
    t = blend.traffic_pages(within(traffic))
    want = blend.blend(blend.search_pages(within(search)), t, blend.crawl_evidence(mine(pages), t, inbound, "https://a.example"))
    got = blend.judged(store.sides("a", START, END, CRAWLED, "o1"))
    columns = [c for c in want.columns if c in got.columns]
    assert {"has_crawl", "canonical_variants", "inbound", "query_count", "insight", "crawl_issue"} <= set(columns)
    show = lambda d: sorted(map(str, d.select(columns).collect()))
    assert show(got) == show(want) and len(show(got)) == 4


def test_plan_has_no_exchange_and_prunes_partitions(spark, store):
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.maxMetadataStringLength": "5000"}
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    try:
        joined = plan_of(blend.judged(store.sides("a", START, END, CRAWLED, "o1")))
        daily = plan_of(store.daily("search", "a", START, END, "o1").groupBy("page_key", "query").agg(F.sum("clicks")))
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    for plan in (joined, daily):
        assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1
        filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S).group(1)
        assert "site#" in filters and "month#" in filters and "source#" in filters


def test_read_files_are_those_of_the_months(store):
    files = store.daily("search", "a", date(1996, 2, 1), date(1996, 2, 20), "o1").select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("/source=search/site=a/month=1996-02-01/" in r["f"] for r in files)


# -- sketches -------------------------------------------------------------------------------------------------------------


def test_sketched_counts_are_within_the_stated_error(spark):
    """A few to 40,000 queries of a page, which repeat over months and edge days."""
    rows = spark.range(200_000).select(
        F.expr("date_add(date'1996-01-10', cast(id % 150 as int))").alias("date"),
        F.when(F.col("id") % 5 == 0, "/small").otherwise("/large").alias("page_key"),
        F.concat(F.lit("q"), F.when(F.col("id") % 5 == 0, F.col("id") % 50).otherwise(F.col("id") % 50_000).cast("string")).alias("query"),
        F.lit(1).cast("long").alias("clicks"),
        (F.col("id") % 7).alias("impressions"),
        (F.col("id") % 9).cast("double").alias("position"),
    )
    start, end = date(1996, 1, 20), date(1996, 5, 20)
    summary = query_sketches.sketched_summary(rows, ["page_key"])
    got = {r["page_key"]: r for r in query_sketches.report(rows, summary, start, end, ["page_key"]).collect()}
    exact = rows.filter(F.col("date").between(start, end)).groupBy("page_key").agg(F.sum("clicks").alias("clicks"), F.count_distinct("query").alias("n"), F.count_distinct("date", "query").alias("days"))
    for r in exact.collect():
        own = got[r["page_key"]]
        assert own["clicks"] == r["clicks"] and own["query_days"] == r["days"]
        assert abs(own["query_count"] - r["n"]) <= query_sketches.MOST_ERROR * r["n"]
    assert got["/small"]["query_count"] == 10 and got["/large"]["query_count"] > 30_000


def test_sketched_report_of_a_short_range_reads_days_only(spark, sf):
    rows = fact(spark, sf, "page_query_daily")
    short = query_sketches.report(rows, rows.limit(0), date(1996, 3, 1), date(1996, 3, 20), ["page_key"])
    want = rows.filter(F.col("date").between(date(1996, 3, 1), date(1996, 3, 20))).groupBy("page_key").agg(F.count_distinct("query").alias("n"))
    assert {(r["page_key"], r["query_count"]) for r in short.collect()} == {tuple(r) for r in want.collect()}


def test_reports_read_one_store(spark, sf):
    """Blend, reconciliation and scoped reports of one application share what is stored."""
    first = catalog_queries.stored_pages(spark, sf)
    assert catalog_queries.stored_pages(spark, sf) is first
    for name in ("r11_blend", "r12_reconciliation"):
        assert first.name in catalog_queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert report_queries.scoped_pages(spark, sf).table.groupBy("source").count().count() == 3


def test_a_store_grows_with_its_table(spark, sf, facts):
    """Buckets and writing tasks by the rows; still one file for each bucket of a partition, and no exchange in its reports."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    few, many = (catalog_queries.page_store(spark, sf, f"of {n}", lambda s: s, n).buckets for n in (rows, rows // 10))
    assert few < many
    made = PageStore(spark, 3, tasks=7).add_search(facts[0])
    try:
        at = F.input_file_name()
        files = made.table.select("source", "site", "month", F.pmod(F.hash("page_key"), F.lit(3)).alias("b"), at.alias("f")).distinct()
        assert made.tasks == 7 and files.count() == files.select("source", "site", "month", "b").distinct().count()
        assert files.groupBy("f").agg(F.count_distinct("b").alias("n")).filter("n > 1").count() == 0
    finally:
        made.drop()


def test_a_store_is_written_in_parts_of_bounded_size(spark, sf):
    """Splits and shuffles follow the table while the store is filled, whatever the session has, which gets its own back."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    seen, before = [], [spark.conf.get(n) for n in names]
    store = catalog_queries.page_store(spark, sf, "parts", lambda s: seen.append([spark.conf.get(n) for n in names]) or s, 10)
    assert seen == [[str(store.tasks), "8m", "16m"]] and [spark.conf.get(n) for n in names] == before
    with pytest.raises(ZeroDivisionError), small_parts(spark, 50):
        assert spark.conf.get(names[0]) == "50"
        raise ZeroDivisionError
    assert [spark.conf.get(n) for n in names] == before


def test_sketches_are_made_by_many_tasks(spark, store, facts):
    """As many tasks as asked for, whatever the buckets; a file for each month and hash range, and the same rows."""
    search = facts[0].filter("page_key <> ''")
    numbers = spark.range(40).withColumnRenamed("id", "_n")
    made = PageStore(spark, 2).add_search(search.join(numbers).withColumn("page_key", F.concat("page_key", F.col("_n").cast("string"))).drop("_n"))
    try:
        shown = lambda d: sorted(map(str, d.withColumn("queries", F.hll_sketch_estimate("queries")).collect()))
        plain = query_sketches.sketched_summary(made.table, ["owner", "site", "page_key"])
        dealt = query_sketches.sketched_summary(made.table, ["owner", "site", "page_key"], tasks=32)
        used = lambda d: d.select(F.spark_partition_id()).distinct().count()
        assert shown(dealt) == shown(plain) and used(plain) <= 2 < used(dealt)
    finally:
        made.drop()
