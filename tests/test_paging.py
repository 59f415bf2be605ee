"""Places in an order, deep pages, the crawl's queue, compatibility forms."""

from __future__ import annotations

import random
from collections import deque
from datetime import date

import pytest
from pyspark.sql import functions as F

from sitelode.functions.unicode_forms import unaccented, without_marks
from sitelode.operators import graph, paging
from sitelode.plans.search_report import SearchReport
from sitelode.sources.providers import expand_sitemaps

KEYS = [("clicks", True), ("day", False), ("id", False)]


@pytest.fixture(scope="module")
def numbers(spark):
    """A third of all rows share one value; nulls in every column of the order but the last."""
    rng = random.Random(3)
    rows = [(rng.choice([0, None, rng.randrange(9)]), rng.choice(["a", None, "b"]), i) for i in range(3000)]
    table = spark.createDataFrame(rows, "clicks int, day string, id int")
    down = lambda v: (1, 0) if v is None else (0, -v)
    up = lambda v: (0, "") if v is None else (1, v)
    return table, sorted(rows, key=lambda r: (down(r[0]), up(r[1]), r[2]))


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_pages_by_buckets_are_those_of_the_sorted_table(numbers, buckets):
    table, plain = numbers
    placed = paging.place(table, paging.ordered(KEYS), buckets)
    assert placed.count == 3000
    for offset, limit in [(0, 1), (0, 3000), (999, 1002), (2990, 50), (3000, 5), (9000, 5)]:
        assert [tuple(r) for r in placed.page(offset, limit).collect()] == plain[offset : offset + limit]
    assert [tuple(r) for r in placed.places().orderBy("place").select("clicks", "day", "id").collect()] == plain


def test_a_page_reads_its_buckets_only(numbers):
    placed = paging.place(numbers[0], paging.ordered(KEYS), 16)
    plan = placed.page(placed.starts[9] + 1, 3)._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "(_bucket#" in scan and ">= 9" in scan and "<= 9" in scan


def test_deep_offsets_take_the_buckets_and_shallow_ones_do_not(numbers, monkeypatch):
    table, plain = numbers
    order = paging.ordered(KEYS)
    assert "_bucket" not in paging.paged(table, order, 10, 20)._jdf.queryExecution().toString()
    monkeypatch.setattr(paging, "MOST_TAKEN", 100)
    assert [tuple(r) for r in paging.paged(table, order, 10, 2000).collect()] == plain[2000:2010]


@pytest.mark.parametrize("at", [0, 700, 1500, 2400, 2999])
def test_the_page_behind_a_row(numbers, at):
    table, plain = numbers
    assert [tuple(r) for r in paging.after(table, KEYS, plain[at], 20).collect()] == plain[at + 1 : at + 21]


def test_equal_rows_and_an_empty_table(spark):
    same = paging.place(spark.range(500).selectExpr("1 AS a"), [F.col("a")], 8)
    assert sorted(r["place"] for r in same.places().collect()) == list(range(500)) and same.page(490, 50).count() == 10
    none = paging.place(spark.range(0).selectExpr("id AS a"), [F.col("a")], 8)
    assert none.count == 0 and none.page(0, 5).count() == 0 and none.places().count() == 0


def test_a_report_goes_on_behind_its_last_row(spark):
    rows = [(date(2026, 1, 1 + i % 3), f"q{i % 40:02}", i % 5, 10 + i % 7, 2.0) for i in range(400)]
    facts = {"query_daily": spark.createDataFrame(rows, "date date, query string, clicks long, impressions long, position double")}
    whole = SearchReport(date(2026, 1, 1), date(2026, 1, 3), ("query",))
    plain = whole.page(facts).collect()
    report = SearchReport(date(2026, 1, 1), date(2026, 1, 3), ("query",), limit=9)
    pages, last = report.page(facts).collect(), None
    while last != pages[-1]:
        last = pages[-1]
        pages += report.after(tuple(last[c] for c, _ in report.order()), facts).collect()
    assert pages == plain and report.placed(facts).page(30, 9).collect() == plain[30:39]


def queue(seeds, links, depth, most):
    """A plain queue: seeds by kind and place, then the links of each page in order."""
    out, seen, waiting = [], set(), deque()

    def take(key, at, kind, parent):
        if key not in seen and (most is None or len(seen) < most):
            seen.add(key)
            waiting.append((key, at))
            out.append((key, at, kind, parent, len(out)))

    for key, kind, _ in sorted(seeds, key=lambda s: (graph.SEED_KINDS.index(s[1]), s[2], s[0])):
        take(key, 0, kind, None)
    while waiting:
        key, at = waiting.popleft()
        if at < depth:
            for to in [t for f, t, _ in sorted((k for k in links if k[0] == key), key=lambda k: (k[2], k[1])) if t != f]:
                take(to, at + 1, "link", key)
    return out


@pytest.mark.parametrize("most", [None, 1, 4, 25, 60, 10_000])
@pytest.mark.parametrize("depth", [0, 1, 4])
def test_the_frontier_is_that_of_a_queue(spark, most, depth):
    """Page 7 has a third of all links; pages link to themselves, twice, and in circles."""
    rng = random.Random(11)
    pages = [f"/p{i:03}" for i in range(120)]
    links = list({(pages[7] if rng.random() < 0.33 else rng.choice(pages), rng.choice(pages), rng.randrange(6)) for _ in range(260)})
    seeds = [(pages[3], "seed", 0), (pages[90], "sitemap", 2), (pages[4], "sitemap", 5), (pages[3], "sitemap", 1), (pages[90], "previous-crawl", 0), (pages[50], "previous-crawl", 1)]
    found = graph.frontier(spark.createDataFrame([(k, f, p) for k, f, p in seeds], "page_key string, discovered_from string, place int"), spark.createDataFrame(links, "from_key string, to_key string, position int"), depth, most)
    rows = found.orderBy("place").collect()
    assert [(r["page_key"], r["depth"], r["discovered_from"], r["discovered_from_key"], r["place"]) for r in rows] == queue(seeds, links, depth, most)


def test_a_frontier_takes_in_every_seed_where_it_is_asked_to(spark):
    seeds = spark.createDataFrame([(f"/s{i}", "sitemap") for i in range(6)], "page_key string, discovered_from string")
    links = spark.createDataFrame([(f"/s{i}", f"/t{i}") for i in range(6)], "from_key string, to_key string")
    keys = lambda most: [r["page_key"] for r in graph.frontier(seeds, links, 2, most, all_seeds=True).orderBy("place").collect()]
    assert keys(4) == keys(6) == [f"/s{i}" for i in range(6)]
    assert keys(8) == [*(f"/s{i}" for i in range(6)), "/t0", "/t1"]


def test_a_frontier_of_odd_tables(spark):
    links = spark.createDataFrame([("/a", "/b"), ("/a", None), (None, "/c")], "from_key string, to_key string")
    none = spark.createDataFrame([], "page_key string, discovered_from string")
    odd = spark.createDataFrame([("/a", None), (None, "seed")], "page_key string, discovered_from string")
    assert graph.frontier(none, links, 3).count() == 0
    assert [(r["page_key"], r["depth"]) for r in graph.frontier(odd, links, 3).orderBy("place").collect()] == [("/a", 0), ("/b", 1)]


def test_sitemaps_without_bounds(spark):
    xml = "<urlset>" + "".join(f"<url><loc>https://a.example/{i}</loc></url>" for i in range(30)) + "</urlset>"
    seeds = spark.createDataFrame([("a.example", "https://a.example/m.xml")], "site string, url string")
    fetched = spark.createDataFrame([("a.example", "https://a.example/m.xml", xml)], "site string, map_url string, xml string")
    assert expand_sitemaps(seeds, fetched, most_urls=10).count() == 10
    assert expand_sitemaps(seeds, fetched, most_maps=None, most_urls=None).count() == 30


def test_compatibility_forms_of_every_code_point(spark):
    codes = spark.range(0x110000).filter("id < 55296 OR id >= 57344")
    text = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex("id"), 8, "0"))), "UTF-32")  # behind a byte-order mark
    wrong = [(r["id"], r["x"]) for r in codes.select("id", unaccented(text).alias("x")).toLocalIterator() if r["x"] != without_marks(chr(r["id"]))]
    assert wrong == []


def test_compatibility_forms_in_texts(spark):
    texts = ["", None, "plain", "Ĳsselmeer ½ ﬁn", "한국어 텍스트", "éáé", "𝐀𝐁 ㎏ ｆｕｌｌ", "Ⅷ 株式会社㍿ ﷺ", "x" * 200_000 + "½é"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", unaccented(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in found] == [None if t is None else without_marks(t) for t in texts]
