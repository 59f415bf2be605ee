"""Golden cases of the engine's operators."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitelode.functions import classify, dates, keys, measures, text
from sitelode.operators import blend, compare, coverage, graph, jobs, links, markup, merge, profiles, topics
from sitelode.plans.search_report import Filter, SearchReport, UnsupportedShape, monthly_summary, months_covered
from sitelode.plans.summary_window import summary_window
from sitelode.sources import access_log, providers
from sitelode.standins import fact
from sitelode.streaming import events as stream

D = date


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values), strict=True))).select(column).first()[0]


@pytest.mark.parametrize(("page", "wanted"), [("https://www.X.com//a///b/?q=1#z", "/a/b"), ("/a/b/", "/a/b"), ("", "/"), (None, "/"), ("https://x.com", "/"), ("  about ", "/about"), ("?q", "/"), ("/A/", "/A")])
def test_page_keys(spark, page, wanted):
    assert one(spark, keys.page_key(F.col("p")), p=page) == wanted


@pytest.mark.parametrize(("canonical", "wanted"), [("https://other.example/c", "/contact"), ("https://WWW.site.example/c/", "/c"), (None, "/contact"), ("", "/contact"), ("/rel", "/rel")])
def test_resolved_keys(spark, canonical, wanted):
    assert one(spark, keys.resolved_key(F.col("u"), F.col("c"), F.lit("https://site.example")), u="https://site.example/contact", c=canonical) == wanted


def test_url_skeletons(spark):
    family = lambda u: one(spark, keys.url_skeleton(F.col("u"))["family"], u=u)
    assert family("https://X.com/en/2024/05/17/a-long-slug/two-parts/7/Page?b=1&a=2&b=3#f") == "x.com/{locale}/{year}/{month}/{day}/{slug}/{compound}/{n}/page?a&b"
    assert family("https://x.com/05/12") == "x.com/{n}/{n}" and family("https://x.com") == "x.com/"


@pytest.mark.parametrize(
    ("start", "end", "months", "edges"),
    [
        (D(2026, 1, 15), D(2026, 4, 10), [D(2026, 2, 1), D(2026, 3, 1)], ((D(2026, 1, 15), D(2026, 1, 31)), (D(2026, 4, 1), D(2026, 4, 10)))),
        (D(2026, 2, 1), D(2026, 3, 31), [D(2026, 2, 1), D(2026, 3, 1)], ()),
        (D(2026, 2, 1), D(2026, 3, 16), None, None),
        (D(2026, 2, 1), D(2026, 3, 17), [D(2026, 2, 1)], ((D(2026, 3, 1), D(2026, 3, 17)),)),
    ],
)
def test_summary_windows(start, end, months, edges):
    window = summary_window(start, end)
    assert (window.months, window.edges) == (months, edges) if months else window is None


def test_monthly_summaries(spark):
    rows = [(D(2026, 2, 10), "alpha", 4, 40, 2.0), (D(2026, 2, 20), "beta", 3, 60, 4.0), (D(2026, 3, 5), "alpha", 6, 50, 3.0), (D(2026, 3, 25), "gamma", 2, 20, 5.0), (D(2026, 3, 1), "", 0, 0, 0.0)]
    daily = spark.createDataFrame(rows, "date date, query string, clicks long, impressions long, position double")
    start, end = D(2026, 1, 15), D(2026, 4, 20)
    summary = monthly_summary(daily)
    assert not months_covered(summary.limit(0), start, end) and months_covered(summary, start, end)
    found = SearchReport(start, end, ("query",)).plan({"query_daily": daily}, {"query_daily": summary}).filter("query = 'alpha'").first()
    assert (found["clicks"], found["impressions"]) == (10, 90) and found["position"] == pytest.approx(230 / 90)
    refreshed = monthly_summary(daily, D(2026, 3, 5), D(2026, 3, 5))
    assert {r["query"]: r["clicks"] for r in refreshed.collect()} == {"alpha": 6, "gamma": 2}


def test_rewritten_ranges_equal_daily_ones(spark, sf):
    rng = random.Random(3)
    daily = {"page_daily": fact(spark, sf, "page_daily").cache()}
    monthly = {"page_daily": monthly_summary(daily["page_daily"]).cache()}
    for _ in range(4):
        start = D(1995, 1, 5) + timedelta(days=rng.randrange(1500))
        report = SearchReport(start, start + timedelta(days=rng.randrange(10, 400)), ("page",))
        shape = lambda df: {r["page_key"]: (r["clicks"], r["impressions"], r["query_days"], round(r["position"], 6), round(r["ctr"], 6)) for r in df.collect()}
        assert shape(report.plan(daily)) == shape(report.plan(daily, monthly))


def test_report_shapes():
    span = (D(2026, 1, 1), D(2026, 1, 2))
    assert SearchReport(*span).grain == "site_daily" and SearchReport(*span, ("page",)).grain == "page_daily"
    assert SearchReport(*span, ("page",), (Filter("query", "equals", "x"),)).grain == "page_query_daily"
    with pytest.raises(UnsupportedShape):
        _ = SearchReport(*span, ("country", "page")).grain
    for bad in ({"dimensions": ("nope",)}, {"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            SearchReport(*span, **bad)
    with pytest.raises(ValueError):
        SearchReport(span[1], span[0])


def test_second_engine(spark):
    payload = '{"d":[{"Query":"brand","Date":"/Date(1782864000000)/","Impressions":10,"Clicks":2,"AvgClickPosition":3,"AvgImpressionPosition":6},{"Query":"brand","Date":"2026-07-01T00:00:00","Impressions":30,"Clicks":6,"AvgClickPosition":5,"AvgImpressionPosition":8},{"Query":"brand","Date":"20260708","Impressions":20,"Clicks":4,"AvgClickPosition":4,"AvgImpressionPosition":10},{"Query":"support","Impressions":5,"Clicks":0,"AvgClickPosition":0,"AvgImpressionPosition":12},{"Query":" "}]}'
    rows = providers.engine2_rows(spark.createDataFrame([(payload, D(2026, 7, 8))], "payload string, fetched_date date"))
    by_day = providers.engine2_totals(rows, ["date", "query"])
    assert by_day.count() == 3 and rows.filter("date_source = 'fetched'").count() == 1
    brand = providers.engine2_totals(rows, ["query"]).filter("query = 'brand'").first()
    assert (brand["impressions"], brand["clicks"], brand["ctr"]) == (60, 12, 0.2)
    assert brand["click_position"] == pytest.approx(52 / 12) and brand["impression_position"] == pytest.approx(500 / 60)


def test_inbound_counts(spark):
    pages = spark.createDataFrame([("/", "/"), ("/pricing", "/pricing"), ("/plans", "/pricing"), ("/contact", "/contact")], "page_key string, resolved_key string")
    edges = spark.createDataFrame([("/", "/pricing"), ("/pricing", "/"), ("/", "/plans")], "from_key string, to_key string")
    found = graph.inbound_resolved(pages, edges)
    assert {r["page_key"]: r["inbound"] for r in found.collect()} == {"/": 1, "/pricing": 2, "/plans": 2, "/contact": 0}
    assert graph.orphans(found).count() == 1
    reached = {r["page_key"]: r["depth"] for r in graph.reach(spark.createDataFrame([("/",)], "page_key string"), edges, 5).collect()}
    assert reached == {"/": 0, "/pricing": 1, "/plans": 1}


def test_ledger(spark):
    names = ["a", "b", "c", "d"]
    old = [(D(2026, 1, d), n, "complete" if d < 3 else "zero" if d == 3 else "partial" if n in "ab" else "complete", d > 3 and n in "ab", None) for d in range(1, 6) for n in names]
    schema = "date date, dataset string, status string, truncated boolean, last_error string"
    ledger = spark.createDataFrame(old, schema)
    errors = spark.createDataFrame([(D(2026, 1, d), n, "error", False, "boom") for d in range(1, 7) for n in names], schema)
    merged = merge.guarded_upsert(ledger, errors, ["date", "dataset"], F.col("status").isin("complete", "zero", "partial"))
    assert merged.exceptAll(ledger).filter("status <> 'error' or date <> '2026-01-06' or last_error <> 'boom'").count() == 0 and merged.count() == 24
    found = {r["date"].day: r["status"] for r in coverage.dataset_status(merged, 4).collect()}
    assert found == {1: "complete", 2: "complete", 3: "zero", 4: "partial", 5: "partial"}


def test_topics(spark):
    base = [("/acoustic-panels", "acoustic wall panels", 80, 1000, 4.0), ("/acoustic-panels", "wall acoustic panels", 40, 500, 5.0), ("/guides/soundproofing", "soundproofing room guide", 5, 400, 18.0), ("/guides/soundproofing", "room soundproofing guide", 4, 300, 19.0)]
    base += [(f"/extra/{i}", f"{'panels ' * (i % 2)}Acoustic  wall panel{'!' * i}", 1, 100 + i, 6.0) for i in range(8)]
    rows = spark.createDataFrame(base, "page_key string, query string, clicks long, impressions long, position double")
    found = {r["topic"]: r for r in topics.topics(rows, spark.createDataFrame([("/acoustic-panels", 20)], "page_key string, inbound long")).collect()}
    assert set(found) == {"acoustic|panel|wall", "guide|room|soundproof"}
    top = found["acoustic|panel|wall"]
    assert top["pages"] == 9 and len(top["top_pages"]) == 8 and len(top["top_queries"]) == 10 and top["inbound"] == 20 and top["status"] == "established" and top["label"] == "acoustic wall panels"
    assert top["score"] == top["visibility"] + top["demand"] + top["depth"] + top["support"] <= 100
    assert found["guide|room|soundproof"]["status"] == "emerging"


def test_thresholds(spark):
    frame = spark.createDataFrame([(x,) for x in (3.0, 3.01, 10.0, 20.0, 20.01)], "p double")
    assert [r[0] for r in frame.select(classify.topic_status(F.col("p"))).collect()] == ["leading", "established", "established", "emerging", "gap"]
    median = lambda xs: spark.createDataFrame([(x,) for x in xs], "x long").agg(measures.median_seconds(F.col("x"))).first()[0]
    jain = lambda xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(measures.fairness(F.col("x"))).first()[0]
    assert median([10, 20]) == 15 and median([5, 7, 100]) == 7 and jain([1.0] * 4) == 1.0 and jain([4.0, 0.0, 0.0, 0.0]) == 0.25
    assert spark.createDataFrame([(-0.5,)], "x double").select(measures.half_up(F.col("x"))).first()[0] == 0


BLEND = "page_key string, clicks long, impressions long, position double, query_count long"


def test_insight_order_and_flags(spark):
    search = spark.createDataFrame([("/a", 6, 600, 3.0, 1), ("/b", 0, 100, 3.0, 1)], BLEND)
    traffic = spark.createDataFrame([("/c", 5, 9, 0.1)], "page_key string, sessions long, page_views long, bounce_rate double")
    crawl = spark.createDataFrame([("/a", 500, True, "t", "d", 1, 9, 0), ("/b", 200, False, "t", "d", 1, 9, 0)], "page_key string, status_code int, noindex boolean, title string, meta_description string, h1_count int, inbound long, canonical_variants long")
    rows = {r["page_key"]: r for r in blend.blend(search, traffic, crawl).collect()}
    assert (rows["/a"]["insight"], rows["/a"]["severity"]) == ("Fix crawl error", "high") and rows["/c"]["insight"] == "Find in crawl"
    flags = {r["page_key"]: r["flags"] for r in blend.reconcile(search, traffic, crawl, traffic_complete=False).collect()}
    assert flags["/b"] == "impressions_without_clicks" and flags["/c"] == "missing_in_crawl,missing_in_search"


def test_canonical_evidence(spark):
    pages = spark.createDataFrame([("https://site.example/a?x", "https://site.example/b", 200, False, "t", "d", 1, 1), ("https://site.example/b", None, 200, False, "own", "d", 1, 2), ("https://site.example/z", "https://site.example/b", 200, False, "t", "d", 1, 3)], "url string, canonical_url string, status_code int, noindex boolean, title string, meta_description string, h1_count int, crawl_order int")
    traffic = spark.createDataFrame([("/a", 5)], "page_key string, sessions long")
    found = {r["page_key"]: r for r in blend.crawl_evidence(pages, traffic, spark.createDataFrame([("/b", 4)], "to_key string, inbound long"), "https://www.site.example").collect()}
    assert set(found) == {"/a", "/b"} and found["/b"]["title"] == "own" and found["/b"]["canonical_variants"] == 2 and found["/a"]["canonical_variants"] == 1 and found["/b"]["inbound"] == 4


def test_log_lines(spark, tmp_path):
    lines = ['1.2.3.4 - - [10/Oct/2023:13:55:36 -0700] "GET /a HTTP/1.1" 200 12 "-" "Googlebot/2.1"', "nonsense", '5.6.7.8 - x [01/Jan/2024:00:00:00 +0000] "POST /b?c HTTP/2" 404 -']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    rows = access_log.parse(df).collect()
    assert (rows[0]["ts"], rows[0]["method"], rows[0]["path"], rows[0]["status"], rows[0]["bot_type"]) == (datetime(2023, 10, 10, 13, 55, 36), "GET", "/a", 200, "Googlebot")
    assert len(rows) == 2 and rows[1]["bot_type"] == "Unknown" and rows[1]["status"] == 404
    assert access_log.parse(df, respect_zone=True).first()["ts"] == datetime(2023, 10, 10, 20, 55, 36)
    import gzip

    with gzip.open(tmp_path / "x.log.gz", "wt") as f:
        f.write("\n".join(lines))
    assert access_log.read(spark, str(tmp_path)).count() == 2
    out = access_log.stream(spark, str(tmp_path)).writeStream.format("memory").queryName("log_rows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert spark.table("log_rows").count() == 2


@pytest.mark.parametrize(("agent", "wanted"), [("", "Unknown"), (None, "Unknown"), ("Mozilla Applebot", "Applebot"), ("ChatGPT-User/1", "ChatGPT / OpenAI"), ("ccbot", "Generic LLM / Scraper"), ("my Spider", "Generic Bot"), ("Firefox", "Human")])
def test_bot_types(spark, agent, wanted):
    assert one(spark, classify.bot_type(F.col("a")), a=agent) == wanted


@pytest.mark.parametrize(("source", "wanted"), [("chat.openai.com", "ChatGPT"), ("Claude.ai", "Claude"), ("bing.com/chat", "Copilot"), ("ai.google.dev", "Gemini"), ("newsletter", "newsletter"), (None, "Other")])
def test_assistant_sources(spark, source, wanted):
    assert one(spark, classify.assistant_source(F.col("s")), s=source) == wanted


@pytest.mark.parametrize(("query", "wanted"), [("acme login", "Navigational"), ("best panels", "Commercial"), ("how to", "Informational"), ("acme panels", "Navigational"), ("panels", "Informational")])
def test_intents(spark, query, wanted):
    assert one(spark, classify.query_intent(F.col("q"), "https://www.acme.com"), q=query) == wanted


def test_text_functions(spark):
    get = lambda f, x: one(spark, f(F.col("x")), x=x)
    long = "This sentence is certainly long enough to be kept by the rule here. Short one. \"Another sentence\" that is long enough to be kept by the same rule, too!"
    assert len(get(text.sentences, long)) == 2 and get(text.topic_key, "Wálls of the Panels") == "panel|wall" and get(text.topic_key, "of") == "of"
    assert get(text.approximate_tokens, "a b  c") == 5 and get(lambda c: text.clean(c, 5), "abc  defg") == "abc…" and get(lambda c: text.phrase_at(c, "wall panel"), "A Wall Panel.") == 3
    assert get(lambda c: text.phrase_at(c, "wall"), "walls") == 0 and get(text.link_tokens, "A big-wall ok") == ["big", "wall"]


def test_dates(spark):
    day = lambda x: one(spark, dates.provider_date(F.col("d")), d=x)
    assert day("/Date(1704067200000)/") == D(2024, 1, 1) and day("20240105") == D(2024, 1, 5) and day("2024-01-05 x") == D(2024, 1, 5) and day("soon") is None
    assert one(spark, dates.bucket(F.to_date("d"), "week"), d="2024-01-10") == D(2024, 1, 7) and one(spark, dates.bucket(F.to_date("d"), "week", 2), d="2024-01-10") == D(2024, 1, 8)
    assert dates.stable_window(D(2026, 1, 3)) == (D(2024, 9, 3), D(2026, 1, 1)) and dates.calendar(spark, D(2026, 1, 2), D(2026, 1, 1)).count() == 0
    assert coverage.chunked(D(2026, 1, 1), D(2026, 1, 10), 7) == [(D(2026, 1, 1), D(2026, 1, 7)), (D(2026, 1, 8), D(2026, 1, 10))]
    assert coverage.fetchable(D(2025, 12, 1), D(2026, 1, 9), D(2026, 1, 5), D(2025, 12, 20)) == (D(2025, 12, 20), D(2026, 1, 3))


def test_robots_and_sitemaps(spark):
    robots = spark.createDataFrame([("s", "# c\nUser-agent: bot\nDisallow: /\nUser-Agent: *\nDisallow: /private\nAllow: /private/open\nSitemap: https://s/map.xml\nDisallow:")], "site string, robots string")
    rules = providers.robots_rules(robots)
    assert rules.count() == 3
    paths = spark.createDataFrame([("s", "/private/x"), ("s", "/private/open/y"), ("s", "/z"), ("t", "/private")], "site string, path string")
    assert {(r["site"], r["path"]): r["allowed"] for r in providers.allowed(paths, rules).collect()} == {("s", "/private/x"): False, ("s", "/private/open/y"): True, ("s", "/z"): True, ("t", "/private"): True}
    maps = spark.createDataFrame([("s.example", '<urlset xmlns="http://x"><url><loc>https://www.s.example/a</loc></url><url><loc>https://t.example/b</loc></url></urlset>')], "site string, xml string")
    assert [r["url"] for r in providers.sitemap_urls(maps).collect()] == ["https://www.s.example/a"]
    payload = spark.createDataFrame([('{"rows":[{"keys":["2024-01-01","q"],"clicks":1,"impressions":2,"ctr":0.5,"position":3},{"keys":["x"],"clicks":null,"impressions":2,"ctr":0.5,"position":3}]}',)], "payload string")
    good, bad = merge.split_valid(providers.search_rows(payload, page_size=2), 2)
    assert good.count() == 1 and bad.count() == 1 and good.first()["truncated"]


def test_compare(spark):
    schema = "date date, clicks long"
    now = spark.createDataFrame([(D(2026, 2, d), d) for d in (1, 2, 4)], schema)
    old = spark.createDataFrame([(D(2026, 1, d), 10 * d) for d in (1, 3, 31)], schema)
    moved = {r["date"].day: (r["clicks"], r["previous_clicks"]) for r in compare.by_offset(now, old, "date", ["clicks"], D(2026, 2, 1), D(2026, 2, 28), D(2026, 1, 1)).collect()}
    assert moved == {1: (1, 10), 2: (2, 0), 3: (0, 30), 4: (4, 0)}
    assert [(r["clicks"], r["previous_clicks"]) for r in compare.by_place(now, old, "date", ["clicks"]).orderBy("place").collect()] == [(1, 10), (2, 30), (4, 310)]


def test_replacing_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.replace_partitions(spark.createDataFrame([(D(2026, 1, 1), 1), (D(2026, 1, 2), 2)], "date date, x long"), path)
    merge.replace_partitions(spark.createDataFrame([(D(2026, 1, 2), 9)], "date date, x long"), path)
    assert sorted((r["date"].day, r["x"]) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 9)]


def test_export(spark, tmp_path):
    grid = spark.createDataFrame([('a "q", b', 1, 3, 1 / 3, 2.25)], "query string, clicks long, impressions long, ctr double, position double")
    providers.write_csv(providers.export_columns(grid, "query").coalesce(1), str(tmp_path / "c"))
    lines = next((tmp_path / "c").glob("*.csv")).read_text().splitlines()
    assert lines[1].startswith('"a ""q"", b",1,3,33.33%,2.')


def test_export_rounds_halves_as_c_does(spark):
    """4.085 is a little less in binary, 4.095 a little more; 2.25 is a true half, which goes to the even digit."""
    rows = [(f"q{i}", 1, 3, x / 100, p) for i, (x, p) in enumerate([(4.085, 2.25), (4.095, 2.35), (1.005, 0.05), (100.0, 12.0)])]
    got = providers.export_columns(spark.createDataFrame(rows, "query string, clicks long, impressions long, ctr double, position double"), "query").collect()
    assert [(r["ctr"], r["position"]) for r in got] == [("%.2f%%" % (ctr * 100), "%.1f" % p) for *_, ctr, p in rows]
    assert got[0]["ctr"] == "4.08%" and got[0]["position"] == "2.2"


PAGE = """<html lang=en><head><title>Room guide</title><meta name=robots content="noindex,follow"><meta name=description content="About rooms"><link rel=canonical href="/guide"><style>p{}</style></head><body>
<header class=site><nav><ul><li><a href="/">Home</a><li><a href="/g">Guides</a></ul></nav><div class=breadcrumb-trail><a href="/">Home</a></div></header>
<main><article><h1>Room guide</h1><section id=basics><h2>Basics</h2><p>Start by measuring the room and finding every surface that reflects sound towards you. Then read the second sentence, which is long enough too.
<h3>Checklist</h3><p>Step by step advice should stand beside a link to the <a href="https://www.site.example/p?x=1">product page</a> so that readers can go on.</p></section>
<div class=product-grid><p>Fabric panels suit offices and shops where the finish matters most of all things. <a href="//cdn.other.example/f">Fabric</a></p></div><section class=faq-block><h2>FAQ</h2><p>Yes, and it often makes speech clearer when the ceiling is treated as well.</p></section></article>
<div class="cta-panel"><p>Book a demo to go through your plan with people who know it.</p><a href="/book">Book</a></div></main>
<footer><p>Privacy policy and newsletter for all who want to read them.</p><a href="mailto:x@y">mail</a><a href="#top">up</a></footer><script>var a="<p>no</p>"</script></body></html>"""


def test_markup(spark):
    pages = [(1, "https://site.example/x", PAGE), (2, None, None), (3, "https://site.example/y", "<p>a<p>b</b></div><li>c"), (4, "https://site.example/x", PAGE.replace("><", ">\n   <").replace("Step by", "Step    by"))]
    got = {r["page_id"]: r for r in markup.snapshots(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    page = got[1]
    assert (page["title"], page["noindex"], page["canonical_url"], page["h1_count"], page["h2_count"], page["language"]) == ("Room guide", True, "https://site.example/guide", 1, 2, "en")
    roles = {r["role"] for r in page["regions"]}
    assert {"main", "header", "navigation", "breadcrumb", "section", "product_grid", "faq", "cta", "footer"} <= roles
    by_text = {b["text"][:12]: b for b in page["blocks"]}
    step = by_text["Step by step"]
    assert step["headings"] == ["Room guide", "Basics", "Checklist"] and "article" in step["dom_path"] and step["role"] == "section"
    assert {x["to_url"]: x["internal"] for x in page["links"]} == {"https://site.example/": True, "https://site.example/g": True, "https://www.site.example/p?x=1": True, "https://cdn.other.example/f": False, "https://site.example/book": True}
    assert next(x for x in page["links"] if "cdn" in x["to_url"])["role"] == "product_grid" and next(x for x in page["links"] if "book" in x["to_url"])["role"] == "cta"
    assert [b["text_hash"] for b in page["blocks"]] == [b["text_hash"] for b in got[4]["blocks"]] and [b["headings"] for b in page["blocks"]] == [b["headings"] for b in got[4]["blocks"]]
    assert all(s["block_key"] in {b["block_key"] for b in page["blocks"]} for s in page["sentences"]) and "var a" not in str(page["blocks"])
    assert by_text["Privacy poli"]["boilerplate"] > 0.6 and got[2]["title"] is None and got[2]["blocks"] == []


def test_profiles(spark):
    fields = "page_id long, url string, title string, h1_text string, word_count int, h1_count int, regions array<struct<role:string,dom_path:string>>"
    pages = [("/privacy-policy", "Privacy", "legal", "reference"), ("/cart/", "Cart", "utility", "navigate"), ("/x", "Frequently asked questions", "faq", "troubleshoot"), ("/y", "Panel calculator", "tool", "calculate"), ("/z", "A versus B", "comparison", "compare"), ("/w", "Hello", "article", "learn"), ("/v", "Our office hours", "location", "find")]
    rows = [(i, f"https://s.example{u}", t, t, 300, 1, []) for i, (u, t, *_) in enumerate(pages)]
    found = profiles.profiles(spark.createDataFrame(rows, fields)).orderBy("page_id").collect()
    assert [(r["page_type"], r["primary_task"]) for r in found] == [(a, b) for *_, a, b in pages]


def test_reasons_of_profiles(spark):
    fields = "page_id long, url string, title string, h1_text string, word_count int, h1_count int, regions array<struct<role:string,dom_path:string>>, has_ratings boolean"
    rows = [(0, "https://s.example/q", "Guide to answers", "", 1500, 1, [], False), (1, "https://s.example/w", "Hello", "", 10, 1, [], None), (2, "https://s.example/e", "A vs B", "", 10, 1, [], True)]
    guide, plain, rated = profiles.profiles(spark.createDataFrame(rows, fields)).orderBy("page_id").collect()
    pairs = lambda r, c: [(x["key"], x["points"]) for x in r[f"{c}_reasons"]]
    # guide 34 + 12 beats faq 44; article has 12
    assert guide["page_type"] == "guide" and pairs(guide, "page_type") == [("guide-signals", 34), ("longform-guide", 12)]
    assert (guide["page_type_score"], guide["page_type_share"], guide["page_type_confidence"]) == (46, 0.451, 0.276)
    assert guide["primary_task"] == "learn" and pairs(guide, "primary_task") == [("guide-learn", 28), ("faq-learn", 14)]
    assert pairs(plain, "page_type") == pairs(plain, "primary_task") == [("fallback", 1)]
    assert (plain["page_type"], plain["page_type_score"], plain["page_type_share"], plain["page_type_confidence"]) == ("article", 1, 1.0, 0.05)
    # the lead of 42 points counts as 40
    assert (rated["page_type"], rated["page_type_confidence"], rated["page_type_label"]) == ("comparison", 0.681, "medium")
    assert rated["primary_task"] == "compare" and rated["primary_task_confidence"] == 0.21


def test_queue(spark):
    t = lambda m: datetime(2026, 1, 1, 0, m)
    rows = [(1, 1, "a", "running", t(0)), (2, 1, "a", "queued", t(1)), (3, 1, "b", "queued", t(2)), (4, 2, "a", "queued", t(3)), (5, 2, "a", "queued", t(4))]
    claim = jobs.claim_order(spark.createDataFrame(rows, "id long, owner long, site string, status string, created_at timestamp"))
    assert [r["id"] for r in claim.collect()] == [4, 3]


def test_nearest_and_its_cells(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 16))
    items = [(i, (base[i % 20] + 0.05 * rng.normal(size=16)).astype(float).tolist()) for i in range(200)] + [(900, [0.0] * 16), (901, [1.0])]
    item = spark.createDataFrame(items, "item long, vector array<double>")
    target = item.filter("item % 10 = 0").withColumnRenamed("item", "target")
    exact = {(r["target"], r["item"]) for r in links.nearest(target.filter("target < 200"), item.filter("item < 900"), 10, 0.8).collect()}
    cells = {(r["target"], r["item"]) for r in links.nearest(target.filter("target < 200"), item.filter("item < 900"), 10, 0.8, dims=16, planes=4).collect()}
    assert len(exact) == 200 and len(exact & cells) / len(exact) >= 0.9


def test_nearest_of_blocks(spark, monkeypatch):
    """Equal to comparing one by one: copies, other lengths, no vector; no row of a vector is made many times for its cells."""
    import numpy as np

    monkeypatch.setattr(links, "PACK", 7)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    rows = [(f"k{i:02}", base[i % 12].tolist()) for i in range(60)] + [("short", [1.0]), ("zero", [0.0] * 8), ("none", None)]
    item = spark.createDataFrame(rows, "item string, vector array<double>")
    found = links.nearest(item.withColumnRenamed("item", "target"), item, 4, 0.2)
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and any(v)}
    want = {t: sorted((-round(float(a @ b), 9), i) for i, b in unit.items() if len(b) == len(a) and a @ b >= 0.2)[:4] for t, a in unit.items()}
    assert sorted((r["target"], r["place"], r["item"]) for r in found.collect()) == sorted((t, n + 1, i) for t, w in want.items() for n, (_, i) in enumerate(w))
    assert "Generate" not in links.nearest(item.withColumnRenamed("item", "target"), item, 4, 0.3, dims=8, planes=4)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_cells(spark, size):
    from sitelode import catalog_queries as c

    exact, cells = ({(r["target"], r["item"]) for r in c.QUERIES[q](spark, f"/root/testdata/{size}").collect()} for q in ("j20_nearest", "j20_nearest_by_cell"))
    print(size, len(exact & cells), len(exact))
    assert len(exact & cells) / len(exact) >= 0.9


def test_choice_keeps_its_caps(spark):
    rows = [("s", f"/s{i % 3}", f"/t{i % 7}", ["Wall panels", "wall panels", "x"][i % 3], 90 - i) for i in range(40)]
    kept = links.choose(spark.createDataFrame(rows, "site string, source_key string, target_key string, anchor string, score int")).collect()
    count = lambda f: max(__import__("collections").Counter(map(f, kept)).values())
    assert count(lambda r: r["source_key"]) <= 3 and count(lambda r: r["target_key"]) <= 5 and count(lambda r: (r["source_key"], r["target_key"])) == 1 and count(lambda r: (r["source_key"], r["anchor"].lower())) == 1
    assert kept[0]["score"] == 90


def test_event_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = stream.windowed(stream.read_events(spark, str(tmp_path / "in")), late="60 days")
    q = live.writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("live").agg(F.sum("events")).first()[0] == events.count() == stream.windowed(events).agg(F.sum("events")).first()[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def greedy(rows):
    """One at a time."""
    sources, targets, texts, used, pairs, kept = {}, {}, {}, set(), set(), []
    for site, source, target, anchor, score in sorted(rows, key=lambda r: (-r[4], r[2], r[1], r[3])):
        full = sources.get((site, source), 0) >= 3 or targets.get((site, target), 0) >= 5 or texts.get((site, target, anchor), 0) >= 2
        if full or (site, source, anchor) in used or (site, source, target) in pairs:
            continue
        for held, key in ((sources, (site, source)), (targets, (site, target)), (texts, (site, target, anchor))):
            held[key] = held.get(key, 0) + 1
        used.add((site, source, anchor))
        pairs.add((site, source, target))
        kept.append((site, source, target, anchor, score))
    return sorted(kept)


def test_choice_in_rounds_is_that_of_one_at_a_time(spark):
    from random import Random

    draw = Random(7)
    rows = list({(f"s{draw.randrange(2)}", f"/a{draw.randrange(12)}", f"/t{draw.randrange(8)}", f"w{draw.randrange(6)}", draw.randrange(50, 70)) for _ in range(600)})
    df = spark.createDataFrame(rows, "site string, source_key string, target_key string, anchor string, score int")
    assert sorted(map(tuple, links.choose(df, None).collect())) == greedy(rows)
    assert links.choose(df, 5).groupBy("site").count().agg(F.max("count")).first()[0] == 5
    assert links.choose(df.limit(0)).isEmpty()


def test_word_candidates_lose_no_pair(spark):
    from random import Random

    draw = Random(3)
    words = ["common"] * 12 + [f"word{i}" for i in range(25)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    targets, sentences = [(f"/t{i}", text(4)) for i in range(25)], [(f"/s{i % 9}", f"h{i}", text(7)) for i in range(60)]
    found = links.word_candidates(spark.createDataFrame(targets, "target_key string, text string"), spark.createDataFrame(sentences, "source_key string, sentence_id string, sentence string"), spark.createDataFrame([("/s1", "/t1")], "from_key string, to_key string"))
    wanted = {(t, s, i, n) for t, x in targets for s, i, y in sentences if (n := len(set(x.split()) & set(y.split()))) >= 2 and (s, t) != ("/s1", "/t1")}
    assert set(map(tuple, found.select("target_key", "source_key", "sentence_id", "overlap").collect())) == wanted


def test_anchor_spans():
    own = lambda s, p, k="": (x := links.anchor_span(s, p, {w for q in [*p, k] for w in links.tokens_of(q)})) and s[slice(*x)]
    assert own("We sell Mountain Bikes for rent here.", ["mountain bikes", "bikes"]) == "Mountain Bikes"
    assert own("We sell mountain bikeshop things", ["mountain bikes"]) is None
    assert own("Our guide, and the article", ["guide", "article"]) is None
    assert own("Rent carbon frames in May", ["Frames of carbon"], "/x/rent") == "Rent carbon frames"
    assert own("Prices | all", ["Prices are low | Shop"]) is None and own("", ["anything long"]) is None


def test_page_tests_and_pairs_that_are_one(spark):
    rows = [("https://a.b/x/one", "/x/one", "https://a.b/x/one/", False, 300, "A title", "h"), ("https://a.b/f.pdf", "/f.pdf", None, False, 300, "t", "h"), ("https://a.b/privacy/", "/privacy", None, False, 300, "t", "h"), ("https://a.b/", "/", None, False, 300, "t", "h"), ("https://a.b/y", "/y", "https://a.b/z", False, 300, "t", "h"), ("https://a.b/n", "/n", None, True, 300, "t", "h"), ("https://a.b/s", "/s", None, False, 30, "t", "h"), ("https://a.b/e", "/e", None, False, 3, " ", None)]
    found = {r["page_key"]: (r["indexable"], r["source_ok"], r["target_ok"]) for r in links.page_tests(spark.createDataFrame(rows, "url string, page_key string, canonical_url string, noindex boolean, word_count int, title string, h1_text string")).collect()}
    assert found == {"/x/one": (True, True, True), "/f.pdf": (False, True, True), "/privacy": (True, False, False), "/": (True, True, False), "/y": (False, True, True), "/n": (False, True, True), "/s": (True, True, False), "/e": (False, True, False)}
    pages = spark.createDataFrame([("/a/one", "u1", None, "t1", "short"), ("/b/one", "u2", None, "t2", "short"), ("/c", "u3", "u1", "t3", ""), ("/d", "u4", None, "t", "The same long heading of both"), ("/e", "u5", None, "t", "the same, long heading of BOTH")], "page_key string, url string, canonical_url string, title string, h1_text string")
    keys = ["/a/one", "/b/one", "/c", "/d", "/e"]
    pairs = spark.createDataFrame([(a, b) for a in keys for b in keys if a < b], "source_key string, target_key string")
    gone = {("/a/one", "/b/one"), ("/a/one", "/c"), ("/d", "/e")}
    assert {tuple(r) for r in links.apart(pairs, pages).collect()} == {(a, b) for a in keys for b in keys if a < b} - gone


def test_markup_without_bounds(spark):
    html = "<html><body><main>" + "".join(f"<p>Paragraph number {i} has enough words to be a block. It also goes on with a second sentence of many words that is long enough.</p>" for i in range(1000)) + "</main></body></html>"
    exact, bounded = markup.page_snapshot("https://a.b/", html), markup.page_snapshot("https://a.b/", html, markup.CRAWLER)
    assert len(exact["blocks"]) == 1000 and len(bounded["blocks"]) == 120 and len(exact["sentences"]) == 1 and len(bounded["sentences"]) == 1
    long = "Word " * 12_000 + "end. " + "This is the last sentence of a long document and has enough words in it to count."
    got = spark.createDataFrame([(long,)], "t string").select(text.sentences(F.col("t")).alias("s")).first()["s"]
    assert len(got) == 2 and got[1].startswith("This is the last") and len(got[0]) > 50_000


def test_sitemaps_are_expanded_level_by_level(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    pages = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    s = "https://a.b/"
    fetched = [("a.b", f"{s}m", index(f"{s}m1", f"{s}m2", f"{s}m", "https://other.c/m")), ("a.b", f"{s}m1", pages(f"{s}1", f"{s}2")), ("a.b", f"{s}m2", index(f"{s}m3")), ("a.b", f"{s}m3", pages(f"{s}3", f"{s}1", "https://other.c/1"))]
    found = providers.expand_sitemaps(spark.createDataFrame([("a.b", f"{s}m")], "site string, url string"), spark.createDataFrame(fetched, "site string, map_url string, xml string"))
    assert {tuple(r) for r in found.collect()} == {("a.b", f"{s}{i}") for i in (1, 2, 3)}
    assert providers.expand_sitemaps(spark.createDataFrame([("a.b", f"{s}m")], "site string, url string"), spark.createDataFrame(fetched, "site string, map_url string, xml string"), most_urls=2).count() == 2


def test_months_are_rebuilt_whole(spark, tmp_path):
    source, target = f"{tmp_path}/events", f"{tmp_path}/months"
    at = lambda m, d: datetime(2024, m, d, 12)
    schema = "ts timestamp, value double"
    spark.createDataFrame([(at(1, 3), 1.0), (at(1, 20), 2.0), (at(2, 5), 4.0)], schema).coalesce(1).write.parquet(source)
    rebuild = lambda rows: rows.groupBy("month_start").agg(F.sum("value").alias("value"))
    run = lambda: stream.refresh_months(stream.read_events(spark, source), spark.read.parquet(source), target, f"{tmp_path}/state", rebuild).awaitTermination()
    read = lambda: {(r["month_start"].month, r["value"]) for r in spark.read.parquet(target).collect()}
    run()
    assert read() == {(1, 3.0), (2, 4.0)}
    spark.createDataFrame([(at(1, 30), 8.0)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert read() == {(1, 11.0), (2, 4.0)}


def test_reports_of_odd_rows(spark):
    from sitelode.operators import reports

    rows = spark.createDataFrame([(None, "s", date(2024, 1, 1), "/a", "A_b%", 1, 10, 2.0), ("o", "s", date(2024, 1, 2), "/a", "axb", 0, 0, 0.0), ("o", "s", date(2024, 1, 2), "", "a", 3, 5, 1.0)], "owner string, site string, date date, page_key string, query string, clicks long, impressions long, position double")
    assert [r["query"] for r in reports.in_scope(rows, None, "s").collect()] == ["A_b%"] and reports.in_scope(rows, "o", "t").isEmpty()
    found = reports.raw_search(rows, "query", date(2024, 1, 1), date(2024, 1, 31), "a_B%").collect()
    assert [(r["query"], r["ctr"]) for r in found] == [("A_b%", 0.1)]  # wild cards are plain characters
    assert [(r["page_key"], r["query_count"], r["ctr"]) for r in reports.raw_search(rows, "page", date(2024, 1, 1), date(2024, 1, 31)).collect()] == [("/a", 2, 0.1)]
    assert reports.raw_search(rows.limit(0), "page_query", date(2024, 1, 1), date(2024, 1, 31), "x").isEmpty()
    with pytest.raises(ValueError):
        reports.traffic_report(rows, ("query",))
    summary = reports.confidence_summary(spark.createDataFrame([("a", 80.0), ("a", 0.6), ("b", None), ("c", 0.1)], "k string, confidence double"), ["k"])
    assert {tuple(r) for r in summary.collect()} == {("a", 0.7, "medium"), ("b", None, "unknown"), ("c", 0.1, "low")}
    days = reports.job_days(spark.createDataFrame([("a", None, date(2024, 1, 2)), ("a", date(2024, 1, 1), date(2024, 1, 2)), ("a", date(2024, 3, 1), date(2024, 3, 2))], "k string, start date, end date"), date(2024, 1, 2), date(2024, 1, 31), ["k"])
    assert [tuple(r) for r in days.collect()] == [("a", date(2024, 1, 2))]


def test_analytics_payloads_that_cannot_be_read(spark):
    good = '{"rows":[{"dimensionValues":[{"value":"20240105"},{"value":"/a?x=1"}],"metricValues":[{"value":"3"},{"value":"none"}]},{"dimensionValues":[{"value":"(other)"}],"metricValues":[]}]}'
    df = spark.createDataFrame([(1, good), (2, "{"), (3, None), (4, "{}")], "id int, payload string")
    got = sorted(map(tuple, providers.analytics_rows(df, ["date", "page_path"], ["sessions", "views"]).collect()), key=str)
    assert got == sorted([(1, date(2024, 1, 5), "/a?x=1", 3.0, 0.0), (1, None, "", 0.0, 0.0)], key=str)


def test_user_sort_falls_back(spark):
    rows = spark.createDataFrame([("/b", 1, True, False, None), ("/A", 1, False, True, 3), ("/c", 5, True, False, 2)], "page_key string, clicks int, noindex boolean, has_traffic boolean, depth int").withColumns({c: F.lit(False) for c in ("crawl_error", "metadata_gap", "has_search", "has_crawl")} | {"canonical_variants": F.lit(0)})
    keys_of = lambda **how: [r["page_key"] for r in blend.page_list(rows, **how).collect()]
    assert keys_of(sort="nothing") == ["/c", "/A", "/b"] and keys_of(sort="page", ascending=True) == ["/A", "/b", "/c"] and keys_of(sort="depth") == ["/A", "/c", "/b"]
    assert keys_of(only="noindex", traffic="without") == ["/c", "/b"] and keys_of(only="what", limit=1, offset=1) == ["/A"]


def test_pages_are_parsed_once_for_templates_and_repeated_blocks(spark, sf):
    """Both use what is parsed several times; it is written before, so their plans have no parsing."""
    from sitelode import catalog_queries

    for name in ("c7_templates", "c7_repeated_blocks"):
        found = catalog_queries.QUERIES[name](spark, sf)
        assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    whole = markup.snapshots(spark.read.parquet(f"{sf}/pages.parquet"))
    part = markup.snapshots(spark.read.parquet(f"{sf}/pages.parquet"), columns=("region_links", "dom"))
    assert part.columns == ["page_id", "url", "dom", "region_links"]
    show = lambda d: sorted(map(str, d.select(part.columns).collect()))
    assert show(part) == show(whole)
