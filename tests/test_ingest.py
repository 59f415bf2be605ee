"""Ingest runs, merges of touched partitions, covering ranges."""

from __future__ import annotations

import os
import random
from datetime import date, timedelta
from glob import glob

import pytest
from pyspark.sql import functions as F

from sitelode.operators import jobs, merge
from sitelode.sources.ingest import Warehouse

ROWS = "keys array<string>, clicks long, impressions long, ctr double, position double"


def row(day: str, page: str, query: str, clicks: int) -> tuple:
    return ([day, page, query], clicks, 10, 0.1, 2.0)


def named(rows):
    return rows.select(F.to_date(F.col("keys")[0]).alias("date"), F.col("keys")[1].alias("page_key"), F.col("keys")[2].alias("query"), "clicks", "impressions", "position")


@pytest.fixture
def warehouse(spark, tmp_path):
    made = Warehouse(spark, f"file://{tmp_path}/w")
    first = [row("2026-01-05", "/a", "x", 1), row("2026-01-05", "/a", "y", 2), row("2026-01-06", "/a", "x", 4), row("2026-02-01", "/b", "x", 8), (["2026-01-05"], 9, 9, 0.1, 1.0), (["2026-01-05", "/a", "z"], None, 9, 0.1, 1.0)]
    counts = made.ingest(spark.createDataFrame(first, ROWS), 3, named, "first")
    assert counts == {"received": 6, "accepted": 4, "rejected": 2, "days": 3}
    return made


def days(warehouse) -> dict:
    return {(str(r["date"]), r["page_key"]): (r["clicks"], r["query_count"]) for r in warehouse.read("pages").collect()}


def months(warehouse) -> dict:
    return {(str(r["month_start"]), r["page_key"], r["query"]): r["clicks"] for r in warehouse.read("months").collect()}


def test_a_run_brings_its_days_and_what_follows_from_them(warehouse):
    assert days(warehouse) == {("2026-01-05", "/a"): (3, 2), ("2026-01-06", "/a"): (4, 1), ("2026-02-01", "/b"): (8, 1)}
    assert months(warehouse) == {("2026-01-01", "/a", "x"): 5, ("2026-01-01", "/a", "y"): 2, ("2026-02-01", "/b", "x"): 8}


def test_a_second_run_replaces_its_days_whole(spark, warehouse):
    warehouse.ingest(spark.createDataFrame([row("2026-01-05", "/c", "x", 16)], ROWS), 3, named, "second")
    assert days(warehouse) == {("2026-01-05", "/c"): (16, 1), ("2026-01-06", "/a"): (4, 1), ("2026-02-01", "/b"): (8, 1)}
    assert months(warehouse) == {("2026-01-01", "/c", "x"): 16, ("2026-01-01", "/a", "x"): 4, ("2026-02-01", "/b", "x"): 8}
    assert [(r["run"], r["accepted"], r["days"]) for r in warehouse.ledger().orderBy("version").collect()] == [("first", 4, 3), ("second", 1, 1)]


@pytest.mark.parametrize("stage", ["_derive_pages", "_derive_months", "_make_current"])
def test_a_run_that_fails_leaves_the_old_days(spark, warehouse, monkeypatch, stage):
    before = days(warehouse), months(warehouse), warehouse.read("search").count()
    rows = spark.createDataFrame([row("2026-01-05", "/c", "x", 16)], ROWS)
    with monkeypatch.context() as broken:
        broken.setattr(Warehouse, stage, lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            warehouse.ingest(rows, 3, named, "second")
    assert (days(warehouse), months(warehouse), warehouse.read("search").count()) == before and warehouse.ledger().count() == 1
    warehouse.ingest(rows, 3, named, "second")  # the same run once more
    assert days(warehouse)[("2026-01-05", "/c")] == (16, 1)


def test_a_manifest_without_its_mark_counts_for_nothing(warehouse):
    root = warehouse.root.removeprefix("file://")
    os.makedirs(f"{root}/manifest/{2:012d}")
    assert len(days(warehouse)) == 3


def test_a_run_without_valid_rows(spark, warehouse):
    counts = warehouse.ingest(spark.createDataFrame([(["x"], 1, 1, 0.1, 1.0)], ROWS), 3, named)
    assert counts["accepted"] == counts["days"] == 0 and len(days(warehouse)) == 3


# -- merges of touched partitions -----------------------------------------------------------------------------------------


def test_a_merge_leaves_the_files_of_other_days(spark, tmp_path):
    path = f"{tmp_path}/t"
    shape = "key string, n long, date date"
    start = date(2026, 1, 1)
    old = [(f"k{i}", i, start + timedelta(days=i % 10)) for i in range(100)]
    merge.replace_partitions(spark.createDataFrame(old, shape), path)
    files = {f: os.stat(f).st_mtime_ns for f in glob(f"{path}/date=*/*.parquet")}
    new = [("k3", 1000, start + timedelta(days=3)), ("new", 1, start + timedelta(days=3)), ("late", 2, start + timedelta(days=40))]
    touched = merge.merge_touched(spark.createDataFrame(new, shape), path, lambda a, b: merge.upsert(a, b, ["date", "key"]))
    assert touched == [start + timedelta(days=3), start + timedelta(days=40)]
    now = {f: os.stat(f).st_mtime_ns for f in glob(f"{path}/date=*/*.parquet")}
    other = {f for f in files if "date=2026-01-04" not in f}
    assert other and all(now[f] == files[f] for f in other) and not (set(files) - other) & set(now)
    want = {(d, k): n for k, n, d in old} | {(d, k): n for k, n, d in new}
    assert {(r["date"], r["key"]): r["n"] for r in spark.read.parquet(path).collect()} == want


@pytest.mark.parametrize("kind", ["insert", "guarded", "count"])
def test_every_merge_can_be_of_touched_days(spark, tmp_path, kind):
    path, shape = f"{tmp_path}/t", "key string, use_count long, date date"
    day = date(2026, 1, 1)
    merge.replace_partitions(spark.createDataFrame([("a", 1, day), ("b", 2, day), ("c", 3, day + timedelta(days=1))], shape), path)
    keys = ["date", "key"]
    how = {"insert": lambda a, b: merge.insert_missing(a, b, keys), "guarded": lambda a, b: merge.guarded_upsert(a, b, keys, F.col("use_count") > 1), "count": lambda a, b: merge.count_uses(a, b, keys)}[kind]
    merge.merge_touched(spark.createDataFrame([("a", 9, day), ("b", 9, day), ("d", 9, day)][: 2 if kind == "count" else 3], shape), path, how)
    got = {r["key"]: r["use_count"] for r in spark.read.parquet(path).collect()}
    assert got == {"insert": {"a": 1, "b": 2, "c": 3, "d": 9}, "guarded": {"a": 9, "b": 2, "c": 3, "d": 9}, "count": {"a": 2, "b": 3, "c": 3}}[kind]


# -- covering ranges ------------------------------------------------------------------------------------------------------


def test_spans_make_up_a_range_once(spark):
    rng = random.Random(2)
    ranges = [(a := date(1965, 1, 1) + timedelta(days=rng.randrange(30_000)), a + timedelta(days=rng.choice([-1, 0, 1, 2, 7, 31, 400, 5000]))) for _ in range(60)]
    df = spark.createDataFrame(ranges, "s date, e date").select("s", "e", jobs.spans_of_range(F.col("s"), F.col("e")).alias("x"))
    for r in df.collect():
        days = [d for x in r["x"] for d in range(x["n"] << x["level"], (x["n"] + 1) << x["level"])]
        first = (r["s"] - date(1970, 1, 1)).days
        assert sorted(days) == list(range(first, first + (r["e"] - r["s"]).days + 1)) and len(r["x"]) <= 32


def test_a_hot_site_meets_only_ranges_over_the_day(spark):
    """100,000 jobs of one site, spread over time: what meets grows with the ranges over a day, not with the site."""
    made = spark.range(100_000).select(F.col("id"), F.lit(1).alias("owner"), F.lit("s").alias("site"), F.lit("queued").alias("status"), F.expr("date_add(date'1990-01-01', cast(id % 12000 as int))").alias("start"), F.expr("date_add(date'1990-01-01', cast(id % 12000 + 3 + id % 5 as int))").alias("end"), F.col("id").alias("updated_at"))
    asked = spark.range(2000).select(F.col("id").alias("request_id"), F.lit(1).alias("owner"), F.lit("s").alias("site"), F.expr("date_add(date'1990-01-01', cast(id * 6 as int))").alias("want_start"), F.expr("date_add(date'1990-01-01', cast(id * 6 + 2 as int))").alias("want_end"))
    met = asked.withColumn("x", F.explode(jobs.spans_of_day(F.col("want_start")))).join(made.withColumn("x", F.explode(jobs.spans_of_range(F.col("start"), F.col("end")))), ["owner", "site", "x"]).count()
    over = asked.join(made.select("start", "end"), (F.col("start") <= F.col("want_start")) & (F.col("end") >= F.col("want_start"))).count()
    assert met == over < 2000 * 100
    assert jobs.covering(asked, made).count() == 2000


# -- markup ---------------------------------------------------------------------------------------------------------------


def test_long_links_and_headings_are_read_whole():
    from sitelode.operators import markup

    words = "linked text of a long block " * 200
    html = f"<html><head><title>{'t' * 500}</title></head><body><h1>{'heading ' * 60}</h1><p><a href='/x'>{words}</a></p></body></html>"
    exact, bounded = markup.page_snapshot("https://a.b/", html), markup.page_snapshot("https://a.b/", html, markup.CRAWLER)
    block = next(b for b in exact["blocks"] if b["block_type"] == "p")
    assert block["link_density"] == 1 and len(exact["title"]) == 500 and len(block["headings"][0]) > 400
    assert len(bounded["title"]) == 220 and len(next(b for b in bounded["blocks"] if b["block_type"] == "p")["headings"][0]) <= 180


def test_covering_jobs_are_not_broadcast(spark, tmp_path):
    """Each job and request becomes several spans, which the size estimate of a broadcast leaves out."""
    made = spark.createDataFrame([(1, 1, 1, "queued", date(2026, 1, 1), date(2026, 1, 20), 1)], "id long, owner long, site long, status string, start date, end date, updated_at long")
    asked = spark.createDataFrame([(7, 1, 1, date(2026, 1, 3), date(2026, 1, 9))], "request_id long, owner long, site long, want_start date, want_end date")
    for name, rows in (("made", made), ("asked", asked)):  # Spark knows the size of files
        rows.write.parquet(f"{tmp_path}/{name}")
    found = jobs.covering(*(spark.read.parquet(f"{tmp_path}/{name}") for name in ("asked", "made")))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(7, 1)]
