"""Pages of a provider's answers as a data source."""

from __future__ import annotations

import json
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sitelode.sources.paged_files import land_pages, read_pages
from sitelode.sources.providers import search_rows


def put(root: Path, day: str, page: int, payload: str) -> None:
    folder = root / f"chunk={day}" / f"page={page}"
    folder.mkdir(parents=True)
    (folder / "part-0.txt").write_text(payload)


def rows(n: int) -> str:
    return json.dumps({"rows": [{"keys": ["2026-01-01", f"q{i}"], "clicks": 1, "impressions": 2, "ctr": 0.5, "position": 3} for i in range(n)]})


@pytest.fixture
def landed(tmp_path):
    for page, n in enumerate([3, 3, 1, 3]):  # the page behind a short one is not asked for
        put(tmp_path, "2026-01-01", page, rows(n))
    for page in (0, 2):  # a page is missing
        put(tmp_path, "2026-01-08", page, rows(3))
    for page in range(5):
        put(tmp_path, "2026-01-15", page, rows(3))
    put(tmp_path, "2026-01-22", 0, "not JSON")
    put(tmp_path, "2026-01-29", 0, rows(0))
    return f"file://{tmp_path}"


def pages(df) -> list:
    return sorted((str(r["chunk"]), r["page"], r["cut_off"]) for r in df.collect())


def test_chunks_are_read_up_to_the_first_page_that_is_not_full(spark, landed):
    assert pages(read_pages(spark, landed, 3, 4)) == [
        *(("2026-01-01", p, False) for p in range(3)),
        ("2026-01-08", 0, False),
        *(("2026-01-15", p, p == 3) for p in range(4)),
        ("2026-01-22", 0, False),
        ("2026-01-29", 0, False),
    ]
    assert search_rows(read_pages(spark, landed, 3, 4), page_size=3).count() == 7 + 3 + 12


@pytest.mark.parametrize(
    ("predicate", "chunks"),
    [("chunk = DATE '2026-01-08'", 1), ("chunk > DATE '2026-01-08' AND chunk <= DATE '2026-01-22'", 2), ("chunk IN (DATE '2026-01-01', DATE '2026-01-29', DATE '2030-01-01')", 2), ("page = 0", 5), ("chunk < DATE '2026-01-15' AND page = 1", 2)],
)
def test_filters_choose_the_partitions(spark, landed, predicate, chunks):
    whole = pages(read_pages(spark, landed, 3, 4).cache().filter(predicate))
    found = read_pages(spark, landed, 3, 4).filter(predicate)
    assert pages(found) == whole and found.rdd.getNumPartitions() == chunks


def test_no_chunk_and_no_folder(spark, landed, tmp_path):
    assert read_pages(spark, landed).filter("chunk > DATE '2030-01-01'").count() == 0
    assert read_pages(spark, f"file://{tmp_path}/none").count() == 0


def test_landed_rows_come_back(spark, tmp_path):
    """A chunk has nine tenths of all rows."""
    made = [(date(2026, 1, 1) + timedelta(days=0 if i % 10 else 7 * (1 + i % 3)), i) for i in range(2000)]
    source = spark.createDataFrame(made, "chunk date, id long")
    row = F.struct(F.array(F.col("chunk").cast("string"), F.col("id").cast("string")).alias("keys"), F.col("id").alias("clicks"), F.lit(1).alias("impressions"), F.lit(0.5).alias("ctr"), F.lit(2.0).alias("position"))
    land_pages(source, row, [F.col("id")], f"file://{tmp_path}/w", 100)
    back = search_rows(read_pages(spark, f"file://{tmp_path}/w", 100), page_size=100)
    assert sorted((r["chunk"], int(r["clicks"])) for r in back.collect()) == sorted(made)
    assert back.filter("chunk = DATE '2026-01-01' AND page = 3").agg(F.min("clicks"), F.count(F.lit(1))).first()[1] == 100
