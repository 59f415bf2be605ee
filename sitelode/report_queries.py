"""Further named queries of the engine: scopes, raw rows, page lists, evidence, payloads and jobs, with DuckDB counterparts."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_queries import _BLEND, _JUDGED, BOUNCE, CRAWLED, CTR, DAYS, END, ORACLE, POSITION, QUERIES, SCOPED_BUCKET_ROWS, SITE, START, SUMS, _key_sql, _log, blended, page_store, query, rounded
from .functions import classify, dates, keys, measures
from .operators import blend, coverage, graph, jobs, profiles, reports
from .plans import query_sketches
from .plans.search_report import Filter, SearchReport, monthly_summary
from .shared import shared_root, stored
from .sources import ingest, providers
from .sources.page_store import PageStore
from .standins import fact, oracle_with

# -- scopes ---------------------------------------------------------------------------------------------------------------

_SCOPED = "date BETWEEN DATE '1996-01-15' AND DATE '1996-09-20' AND site = 'https://site-3.example'"


@query("s1_scoped_report", oracle_with("scoped_daily") + f"SELECT page_key, query, {SUMS}, {CTR}, {POSITION} FROM scoped_daily WHERE {_SCOPED} AND owner = 'owner1' AND contains(query, '1') GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 500")
def s1_scoped_report(spark: SparkSession, sf: str) -> DataFrame:
    report = SearchReport(START, END, ("page", "query"), (Filter("query", "contains", "1"),), limit=500, site="https://site-3.example", owner="owner1")
    rows = scoped_pages(spark, sf).daily("search", report.site, START, END, report.owner)
    return rounded(report.page({report.grain: rows}), "ctr", "position")


def scoped_pages(spark: SparkSession, sf: str) -> PageStore:
    """Facts of five sites with owners, of which some rows have none; as many pages and queries as the tables have."""

    def fill(store: PageStore) -> PageStore:
        links = fact(spark, sf, "scoped_links").filter("from_key <> to_key").groupBy("site", "to_key").agg(F.count(F.lit(1)).alias("inbound"))
        return store.add_search(fact(spark, sf, "scoped_daily")).add_traffic(fact(spark, sf, "scoped_traffic")).add_crawl(fact(spark, sf, "scoped_crawl"), links, SITE, CRAWLED)

    return page_store(spark, sf, "scoped", fill, SCOPED_BUCKET_ROWS)


_OF_SITE = "owner = 'owner1' AND site = 'https://site-3.example'"
_SITE_BLEND = (
    oracle_with("scoped_daily", "scoped_traffic", "scoped_crawl", "scoped_links")
    + f""", page_query_daily AS (SELECT * FROM scoped_daily WHERE {_SCOPED} AND {_OF_SITE}), traffic_page_daily AS (SELECT * FROM scoped_traffic WHERE {_SCOPED} AND {_OF_SITE}),
    crawl_pages AS (SELECT * EXCLUDE (owner, site) FROM scoped_crawl WHERE {_OF_SITE}), crawl_links AS (SELECT * FROM scoped_links WHERE site = 'https://site-3.example')"""
    + _JUDGED
)


def _of_site(spark: SparkSession, sf: str) -> DataFrame:
    return blend.judged(scoped_pages(spark, sf).sides("https://site-3.example", START, END, CRAWLED, "owner1"))


@query("r11_site_blend", _SITE_BLEND + "SELECT page_key, has_search, has_traffic, has_crawl, clicks, impressions, round(position, 6) AS position, query_count, sessions, page_views, round(bounce_rate, 6) AS bounce_rate, canonical_variants, inbound, crawl_issue, insight, severity FROM v")
def r11_site_blend(spark: SparkSession, sf: str) -> DataFrame:
    """One site of one owner in a range: an aggregate over the pruned, bucketed store."""
    shown = _of_site(spark, sf).select("page_key", "has_search", "has_traffic", "has_crawl", "clicks", "impressions", "position", "query_count", "sessions", "page_views", "bounce_rate", "canonical_variants", "inbound", "crawl_issue", "insight", "severity")
    return rounded(shown, "position", "bounce_rate")


@query("r12_site_reconciliation", _SITE_BLEND + """, f AS (SELECT *, list_filter([CASE WHEN (has_search OR has_traffic) AND NOT has_crawl THEN 'missing_in_crawl' END, CASE WHEN (has_traffic OR has_crawl) AND NOT has_search THEN 'missing_in_search' END, CASE WHEN (has_search OR has_crawl) AND NOT has_traffic THEN 'missing_in_traffic' END,
    CASE WHEN has_crawl AND (status_code IS NULL OR status_code >= 400) THEN 'crawl_error' END, CASE WHEN noindex THEN 'noindex' END, CASE WHEN canonical_variants > 0 THEN 'canonical_mismatch' END, CASE WHEN impressions >= 100 AND clicks = 0 THEN 'impressions_without_clicks' END], lambda x: x IS NOT NULL) AS fl FROM v)
    SELECT page_key, has_search, has_traffic, has_crawl, clicks, impressions, sessions, coalesce(array_to_string(fl, ','), '') AS flags, CASE WHEN len(fl) = 0 THEN 'matched' ELSE 'flagged' END AS status, len(fl) * 1e9 + impressions * 100.0 + clicks * 10.0 + sessions AS score FROM f""")
def r12_site_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    return blend.reconciled(_of_site(spark, sf))


_SKETCHED: dict[tuple[str, str], DataFrame] = {}


@query("a7_queries_from_sketches", oracle_with("scoped_daily") + f"SELECT page_key, {SUMS}, {CTR}, {POSITION}, COUNT(DISTINCT (date, query)) AS query_days, COUNT(DISTINCT query) AS query_count FROM scoped_daily WHERE {_SCOPED} AND {_OF_SITE} AND query <> '' GROUP BY 1")
def a7_queries_from_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct queries of pages from monthly sketches and edge days; few queries a page, so the estimate is the count."""
    site, owner = "https://site-3.example", "owner1"
    at = (spark.sparkContext.applicationId, sf)
    if at not in _SKETCHED:
        store = scoped_pages(spark, sf)
        summary = query_sketches.sketched_summary(store.table.filter("source = 'search'"), ["owner", "site", "page_key"], tasks=store.tasks)
        _SKETCHED[at] = stored(summary, "query-sketches", "month_start")
    months = _SKETCHED[at].filter((F.col("site") == site) & (F.col("owner") == owner)).drop("owner", "site")
    days = scoped_pages(spark, sf).daily("search", site, START, END, owner)
    return rounded(query_sketches.report(days, months, START, END, ["page_key"]), "ctr", "position")


@query("j9_rows_without_owner", oracle_with("scoped_daily") + f"SELECT query, {SUMS}, {CTR}, {POSITION} FROM scoped_daily WHERE {_SCOPED} AND owner IS NULL GROUP BY 1")
def j9_rows_without_owner(spark: SparkSession, sf: str) -> DataFrame:
    """Through months and edges; every group, without order and limit."""
    rows = fact(spark, sf, "scoped_daily")
    report = SearchReport(START, END, ("query",), (Filter("page", "notContains", "none"),), site="https://site-3.example")
    return rounded(report.plan({report.grain: rows}, {report.grain: monthly_summary(rows)}), "ctr", "position")


@query("j9_same_owner", oracle_with("scoped_daily") + ", a AS (SELECT DISTINCT owner, site FROM scoped_daily WHERE clicks > 2), b AS (SELECT owner, site, COUNT(*) AS days FROM (SELECT DISTINCT owner, site, date FROM scoped_daily) GROUP BY 1, 2) SELECT a.owner, a.site, days FROM a JOIN b ON a.owner IS NOT DISTINCT FROM b.owner AND a.site = b.site")
def j9_same_owner(spark: SparkSession, sf: str) -> DataFrame:
    rows = fact(spark, sf, "scoped_daily")
    days = rows.select("owner", "site", "date").distinct().groupBy("owner", "site").agg(F.count(F.lit(1)).alias("days"))
    return reports.same_owner(rows.filter("clicks > 2").select("owner", "site").distinct(), days, ["site"])


@query("j13_preferred_source", "WITH s AS (SELECT c_nationkey AS scope, CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'traffic' WHEN 1 THEN 'search' ELSE 'crawl' END AS kind, c_custkey AS source, c_custkey % 50 AS created_at FROM customer WHERE c_acctbal > 9500), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY CASE kind WHEN 'search' THEN 1 WHEN 'traffic' THEN 2 ELSE 3 END, created_at, source) rn FROM s) SELECT n_nationkey AS scope, kind, source FROM nation LEFT JOIN (SELECT * FROM r WHERE rn = 1) ON n_nationkey = scope")
def j13_preferred_source(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 3 == 0, "traffic").when(F.col("c_custkey") % 3 == 1, "search").otherwise("crawl")
    sources = spark.read.parquet(f"{sf}/customer.parquet").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("scope"), kind.alias("kind"), F.col("c_custkey").alias("source"), (F.col("c_custkey") % 50).alias("created_at"))
    return reports.preferred(spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("scope")), sources, ["search", "traffic"])


# -- raw rows -------------------------------------------------------------------------------------------------------------

_RAW_CTR = "round(CASE WHEN impressions > 0 THEN CAST(clicks AS DOUBLE) / impressions ELSE 0 END, 6) AS ctr"


def _raw(name: str, kind: str, search: str = "", limit: int = 100, offset: int = 0):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = reports.raw_search(fact(spark, sf, name), kind, START, END, search, limit, offset)
        longs = found.withColumns({c: F.col(c).cast("long") for c in ("clicks", "impressions")})
        return rounded(longs, "ctr", "position")

    return run


_LONGS = "CAST(clicks AS BIGINT) AS clicks, CAST(impressions AS BIGINT) AS impressions"
query("r2_raw_site", oracle_with("site_daily") + f"SELECT date, {_LONGS}, {_RAW_CTR}, round(position, 6) AS position FROM site_daily WHERE {DAYS} AND contains(CAST(date AS VARCHAR), '-03-') ORDER BY date DESC LIMIT 20 OFFSET 5")(_raw("site_daily", "site", "-03-", 20, 5))
query("r2_raw_query", oracle_with("query_daily") + f"SELECT date, query, {_LONGS}, {_RAW_CTR}, round(position, 6) AS position FROM query_daily WHERE {DAYS} AND contains(lower(query), 'part 1') ORDER BY date DESC, clicks DESC, impressions DESC, query LIMIT 100")(_raw("query_daily", "query", "PART 1"))
query("r2_raw_page", oracle_with("page_query_daily") + f"SELECT page_key, {SUMS}, {CTR}, {POSITION}, COUNT(DISTINCT query) AS query_count FROM page_query_daily WHERE {DAYS} AND contains(lower(page_key), '/p1') GROUP BY 1 ORDER BY SUM(clicks) DESC, SUM(impressions) DESC, 1 LIMIT 12")(_raw("page_query_daily", "page", "/P1", 12))
query("r2_raw_page_query", oracle_with("page_query_daily") + f"SELECT date, page_key, query, {_LONGS}, {_RAW_CTR}, round(position, 6) AS position FROM page_query_daily WHERE {DAYS} ORDER BY date DESC, clicks DESC, impressions DESC, page_key, query LIMIT 150 OFFSET 50")(_raw("page_query_daily", "page_query", "", 150, 50))
_TRAFFIC = "CAST(SUM(sessions) AS BIGINT) AS sessions, CAST(SUM(total_users) AS BIGINT) AS total_users, CAST(SUM(page_views) AS BIGINT) AS page_views"


@query("r3_raw_traffic_pages", oracle_with("traffic_page_daily") + f"SELECT page_key, {_TRAFFIC}, CAST(SUM(event_count) AS BIGINT) AS event_count, {BOUNCE} FROM traffic_page_daily WHERE page_key <> '' AND contains(page_key, '/p2') GROUP BY 1 ORDER BY 2 DESC, 4 DESC, 1 LIMIT 25")
def r3_raw_traffic_pages(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.raw_traffic(fact(spark, sf, "traffic_page_daily"), "page", "/p2", 25), "bounce_rate")


@query("r4_raw_dimension", oracle_with("traffic_dimension_daily") + f"SELECT dimension, dimension_value, {_TRAFFIC}, {BOUNCE} FROM traffic_dimension_daily WHERE dimension = 'event' AND dimension_value <> '' AND contains(dimension_value, 'i') GROUP BY 1, 2 ORDER BY 3 DESC, 5 DESC, 2 LIMIT 100")
def r4_raw_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.raw_dimension(fact(spark, sf, "traffic_dimension_daily"), "event", "I"), "bounce_rate")


# -- traffic, referrals, coverage -----------------------------------------------------------------------------------------


@query("r5_traffic_by_date", oracle_with("traffic_page_daily") + f"SELECT date, {_TRAFFIC}, CAST(SUM(event_count) AS BIGINT) AS event_count, {BOUNCE} FROM traffic_page_daily GROUP BY 1")
def r5_traffic_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.traffic_report(fact(spark, sf, "traffic_page_daily"), ("date",)), "bounce_rate")


@query("r5_traffic_of_page", oracle_with("traffic_page_daily") + f"SELECT date, page_key, {_TRAFFIC}, CAST(SUM(event_count) AS BIGINT) AS event_count, {BOUNCE} FROM traffic_page_daily WHERE page_key = '/s1/p1' GROUP BY 1, 2")
def r5_traffic_of_page(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.traffic_report(fact(spark, sf, "traffic_page_daily"), ("date", "page_key"), "/s1/p1"), "bounce_rate")


_CLASS = "CASE WHEN lower(source) LIKE '%chatgpt%' THEN 'ChatGPT' WHEN lower(source) LIKE '%claude%' THEN 'Claude' WHEN lower(source) LIKE '%perplexity%' THEN 'Perplexity' WHEN lower(source) LIKE '%copilot%' THEN 'Copilot' WHEN lower(source) LIKE '%gemini%' THEN 'Gemini' ELSE source END AS source_class"
_REFERRED = oracle_with("llm_referral_daily") + f", r AS (SELECT *, {_CLASS} FROM llm_referral_daily WHERE source <> '') "
_REFERRALS = "CAST(SUM(sessions) AS BIGINT) AS sessions, CAST(SUM(engaged_sessions) AS BIGINT) AS engaged_sessions, round(SUM(key_events), 6) AS key_events, round(SUM(average_session_duration * sessions) / SUM(sessions), 6) AS duration"


def _referrals(part: str):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = fact(spark, sf, "llm_referral_daily").withColumn("source_class", classify.assistant_source(F.col("source")))
        found = reports.referral_report(rows)[part]
        return found if part == "daily" else rounded(found, "key_events", "duration")

    return run


query("r7_referrals_daily", _REFERRED + "SELECT date, CAST(SUM(sessions) AS BIGINT) AS sessions FROM r GROUP BY 1")(_referrals("daily"))
query("r7_referrals_by_source", _REFERRED + f"SELECT source, source_class, {_REFERRALS} FROM r GROUP BY 1, 2")(_referrals("source"))
query("r7_referrals_by_page", _REFERRED + f"SELECT page_key, source, source_class, {_REFERRALS} FROM r WHERE page_key <> '' GROUP BY 1, 2, 3 ORDER BY sessions DESC, page_key, source LIMIT 500")(_referrals("landing"))
query("r7_referral_totals", _REFERRED + f"SELECT {_REFERRALS}, COUNT(DISTINCT source) AS sources, COUNT(DISTINCT nullif(page_key, '')) AS pages FROM r")(_referrals("totals"))

_DATASETS = ("site_daily", "query_daily", "country_daily", "page_query_daily", "traffic_page_daily", "traffic_dimension_daily", "llm_referral_daily")


@query("r8_coverage_by_dataset", oracle_with(*_DATASETS) + ", h AS (" + " UNION ALL ".join(f"SELECT DISTINCT '{d}' AS dataset, date FROM {d}" for d in _DATASETS) + "), d AS (SELECT CAST(range AS DATE) AS date FROM range(DATE '1998-06-01', DATE '2024-02-06', INTERVAL 1 DAY)), n AS (SELECT unnest([" + ", ".join(f"'{d}'" for d in _DATASETS) + "]) AS dataset) SELECT n.dataset, COUNT(*) AS expected, COUNT(h.date) AS covered, round(COUNT(h.date) / CAST(COUNT(*) AS DOUBLE), 6) AS ratio, MIN(h.date) AS first_day, MAX(h.date) AS last_day FROM n CROSS JOIN d LEFT JOIN h ON h.dataset = n.dataset AND h.date = d.date GROUP BY 1")
def r8_coverage_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    held = [fact(spark, sf, d).select(F.lit(d).alias("dataset"), "date").distinct() for d in _DATASETS]
    rows = held[0]
    for more in held[1:]:
        rows = rows.unionByName(more)
    return rounded(coverage.by_dataset(rows, list(_DATASETS), date(1998, 6, 1), date(2024, 2, 5)), "ratio")


@query("a14_top_queries", oracle_with("product_queries") + ", p AS (SELECT page_key, query, SUM(clicks) c, SUM(impressions) i, SUM(position * impressions) w, row_number() OVER (PARTITION BY page_key ORDER BY SUM(impressions) DESC, query) rn FROM product_queries GROUP BY 1, 2) SELECT page_key, CAST(SUM(c) AS BIGINT) AS clicks, CAST(SUM(i) AS BIGINT) AS impressions, round(SUM(w) / SUM(i), 6) AS position, COUNT(*) AS query_count, string_agg(query, '|' ORDER BY rn) FILTER (rn <= 6) AS top_queries FROM p GROUP BY 1")
def a14_top_queries(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.top_queries(fact(spark, sf, "product_queries")), "position").withColumn("top_queries", F.array_join("top_queries", "|"))


# -- page lists -----------------------------------------------------------------------------------------------------------

_LISTED = "page_key, clicks, impressions, sessions, round(bounce_rate, 6) AS bounce_rate, inbound, crawl_issue"


def _listed(**how: object):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        shown = blend.page_list(blended(spark, sf), **how)
        return rounded(shown.select("page_key", "clicks", "impressions", "sessions", "bounce_rate", "inbound", "crawl_issue"), "bounce_rate")

    return run


query("o4_pages_by_bounce", _BLEND + f"SELECT {_LISTED} FROM v WHERE has_traffic AND contains(page_key, '/p') ORDER BY v.bounce_rate, page_key LIMIT 40 OFFSET 10")(_listed(sort="bounce_rate", ascending=True, search="/P", traffic="with", limit=40, offset=10))
query("o4_pages_by_issue", _BLEND + f"SELECT {_LISTED} FROM v WHERE noindex OR canonical_variants > 0 ORDER BY crawl_issue DESC, page_key LIMIT 60")(_listed(sort="crawl_status", only="indexability", limit=60))
query("o4_pages_by_links", _BLEND + f"SELECT {_LISTED} FROM v WHERE NOT has_traffic AND NOT has_search ORDER BY inbound DESC, page_key LIMIT 50")(_listed(sort="inlinks", only="missing-search", traffic="without", limit=50))
query("o4_pages_by_key", _BLEND + f"SELECT {_LISTED} FROM v ORDER BY lower(page_key) DESC LIMIT 30")(_listed(sort="page", limit=30))

_FLAGGED = _BLEND + """, f AS (SELECT *, [CASE WHEN (has_search OR has_traffic) AND NOT has_crawl THEN 'missing_in_crawl' END, CASE WHEN (has_traffic OR has_crawl) AND NOT has_search THEN 'missing_in_search' END, CASE WHEN (has_search OR has_crawl) AND NOT has_traffic THEN 'missing_in_traffic' END,
      CASE WHEN has_crawl AND (status_code IS NULL OR status_code >= 400) THEN 'crawl_error' END, CASE WHEN noindex THEN 'noindex' END, CASE WHEN canonical_variants > 0 THEN 'canonical_mismatch' END, CASE WHEN impressions >= 100 AND clicks = 0 THEN 'impressions_without_clicks' END] AS listed FROM v),
    g AS (SELECT *, list_filter(listed, lambda x: x IS NOT NULL) flags FROM f), u AS (SELECT *, unnest(flags) AS flag, unnest(range(len(flags))) AS place FROM g) """


@query(
    "k7_reasons",
    _FLAGGED
    + """SELECT page_key, CAST(place AS INT) AS place, flag, CASE flag WHEN 'missing_in_crawl' THEN 'Not found by crawler' WHEN 'missing_in_search' THEN 'No search visibility row' WHEN 'missing_in_traffic' THEN 'No GA4 landing-page match' WHEN 'crawl_error' THEN 'Crawler could not fetch page' WHEN 'noindex' THEN 'Indexability conflict' WHEN 'canonical_mismatch' THEN 'Canonical variants found' ELSE 'SERP demand without clicks' END AS label,
    CASE flag WHEN 'missing_in_search' THEN 'neutral' WHEN 'missing_in_traffic' THEN 'neutral' WHEN 'crawl_error' THEN 'danger' WHEN 'noindex' THEN CASE WHEN has_search THEN 'danger' ELSE 'warning' END ELSE 'warning' END AS tone,
    CASE flag WHEN 'missing_in_crawl' THEN CASE WHEN has_search THEN format('{:,}', impressions) || ' impressions, but the crawl lacks the page.' ELSE 'Sessions, but the crawl lacks the page.' END WHEN 'missing_in_search' THEN CASE WHEN has_crawl THEN 'Crawled, but search has no row in the range.' ELSE 'Sessions, but search has no row in the range.' END
      WHEN 'missing_in_traffic' THEN 'Known, but no landing page matches its path.' WHEN 'crawl_error' THEN 'Status ' || coalesce(CAST(status_code AS VARCHAR), 'none') || '.' WHEN 'noindex' THEN CASE WHEN has_search THEN 'Marked noindex, yet ' || format('{:,}', impressions) || ' impressions.' ELSE 'Marked noindex.' END
      WHEN 'canonical_mismatch' THEN CAST(canonical_variants AS VARCHAR) || CASE WHEN canonical_variants = 1 THEN ' variant' ELSE ' variants' END || ' under this page.' ELSE format('{:,}', impressions) || ' impressions and no clicks.' END AS detail FROM u""",
)
def k7_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return blend.reasons(blend.flagged(blended(spark, sf)))


_STATUSES = ("all", "issues", "matched", *blend.STATUS_FLAGS)


@query("k8_statuses", _FLAGGED + "SELECT 'all' AS status, COUNT(*) AS pages FROM g UNION ALL SELECT 'issues', count_if(len(flags) > 0) FROM g UNION ALL SELECT 'matched', count_if(len(flags) = 0) FROM g" + "".join(f" UNION ALL SELECT '{s}', count_if(list_contains(flags, '{f}')) FROM g" for s, f in blend.STATUS_FLAGS.items()))
def k8_statuses(spark: SparkSession, sf: str) -> DataFrame:
    rows = blend.flagged(blended(spark, sf))
    counted = [blend.with_status(rows, s).agg(F.lit(s).alias("status"), F.count(F.lit(1)).alias("pages")) for s in _STATUSES]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


@query("j23_index_grid", oracle_with("page_daily", "access_log", "crawl_pages") + rf""", norm AS (SELECT regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') || '/' AS url, CASE WHEN crawl_order % 3 = 0 THEN 'Submitted and indexed' ELSE 'Crawled - currently not indexed' END AS state, crawl_order FROM crawl_pages),
    s AS (SELECT '{SITE}' || page_key || '/' AS url, CAST(SUM(clicks) AS BIGINT) AS clicks, CAST(SUM(impressions) AS BIGINT) AS impressions FROM page_daily GROUP BY 1),
    l AS (SELECT '{SITE}' || regexp_extract(line, '"(\S+) (\S+) ', 2) || '/' AS url, MAX(strptime(split_part(regexp_extract(line, '\[([^\]]+)\]', 1), ' ', 1), '%d/%b/%Y:%H:%M:%S')) AS last_crawl FROM access_log WHERE line LIKE '%Googlebot%' GROUP BY 1),
    i AS (SELECT replace(url, 'www.', '') AS url, max_by(state, crawl_order) AS coverage_state FROM norm GROUP BY 1)
    SELECT coalesce(s.url, l.url, i.url) AS url, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions, last_crawl, coverage_state FROM s FULL JOIN l ON s.url = l.url FULL JOIN i ON coalesce(s.url, l.url) = i.url""")
def j23_index_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Search pages, bot visits without noise paths, and inspections, on one address."""
    shown = fact(spark, sf, "page_daily").groupBy(keys.grid_url(F.concat(F.lit(SITE), "page_key")).alias("url")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    seen = _log(spark, sf).filter("bot_type = 'Googlebot'").filter(~keys.is_asset(F.col("path")) & ~keys.is_noise(F.col("path")))
    seen = seen.groupBy("path").agg(F.max("ts").alias("last_crawl")).groupBy(keys.grid_url(F.concat(F.lit(SITE), "path")).alias("url")).agg(F.max("last_crawl").alias("last_crawl"))
    state = F.when(F.col("crawl_order") % 3 == 0, "Submitted and indexed").otherwise("Crawled - currently not indexed")
    inspected = fact(spark, sf, "crawl_pages").groupBy(F.replace(keys.grid_url(F.col("url")), F.lit("www."), F.lit("")).alias("url")).agg(F.max_by(state, "crawl_order").alias("coverage_state"))
    return shown.join(seen, "url", "full_outer").join(inspected, "url", "full_outer").fillna(0, ["clicks", "impressions"])


@query("p14_noise_paths", "SELECT x AS path, x LIKE '%/.%' OR x LIKE '%.php' OR x LIKE '%.env%' OR x LIKE '%.bak' AS noise FROM (SELECT unnest(['/a', '/.git/config', '/x.php', '/x.phpx', '/a.env.local', '/b.bak', '/c.bak/d', '/d.e']) AS x)")
def p14_noise_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = spark.createDataFrame([(x,) for x in ("/a", "/.git/config", "/x.php", "/x.phpx", "/a.env.local", "/b.bak", "/c.bak/d", "/d.e")], "path string")
    return paths.withColumn("noise", keys.is_noise(F.col("path")))


@query("r13_issue_pages", oracle_with("crawl_pages", "crawl_links") + f", k AS (SELECT *, {_key_sql('url')} AS page_key FROM crawl_pages), i AS (SELECT to_key, COUNT(*) inbound FROM crawl_links WHERE from_key <> to_key GROUP BY 1) SELECT crawl_order, page_key, status_code, coalesce(inbound, 0) AS inbound FROM k LEFT JOIN i ON page_key = to_key WHERE status_code IS NULL OR status_code >= 400 OR noindex OR trim(coalesce(title, '')) = '' OR trim(coalesce(meta_description, '')) = '' OR (coalesce(canonical_url, '') <> '' AND canonical_url <> url) OR coalesce(inbound, 0) = 0")
def r13_issue_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = fact(spark, sf, "crawl_pages").withColumns({"page_key": keys.page_key(F.col("url")), "normalized_url": F.col("url")})
    found = pages.join(graph.inbound(fact(spark, sf, "crawl_links")), F.col("page_key") == F.col("to_key"), "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    return found.filter(classify.crawl_issue()).select("crawl_order", "page_key", "status_code", "inbound")


@query("j22_audit_with_search", oracle_with("crawl_pages", "page_daily") + f""", k AS (SELECT crawl_order, {_key_sql('url')} AS page_key, status_code, noindex, word_count FROM crawl_pages), s AS (SELECT page_key, CAST(SUM(clicks) AS BIGINT) clicks, CAST(SUM(impressions) AS BIGINT) impressions FROM page_daily WHERE page_key <> '' GROUP BY 1)
    SELECT crawl_order, k.page_key, coalesce(clicks, 0) AS clicks, coalesce(impressions, 0) AS impressions FROM k LEFT JOIN s ON k.page_key = s.page_key""")
def j22_audit_with_search(spark: SparkSession, sf: str) -> DataFrame:
    found = profiles.with_search(blend.keyed_crawl(fact(spark, sf, "crawl_pages"), SITE), fact(spark, sf, "page_daily"))
    return found.select("crawl_order", F.col("raw_key").alias("page_key"), "clicks", "impressions")


# -- evidence -------------------------------------------------------------------------------------------------------------

_AUTHORITY = ("authority_pages", "authority_profiles", "authority_members", "authority_clusters", "authority_regions")


@query(
    "j10_authority_pages",
    oracle_with(*_AUTHORITY)
    + """, k AS (SELECT page_key FROM authority_profiles UNION SELECT page_key FROM authority_members UNION SELECT page_key FROM authority_regions),
    m AS (SELECT page_key, MIN(template_key) AS mk, MIN(distance) AS distance, bool_or(coalesce(is_exemplar, false)) AS is_exemplar FROM authority_members GROUP BY 1)
    SELECT k.page_key, p.url, p.title, f.page_type, f.confidence, coalesce(f.template_key, mk) AS template_key, distance, is_exemplar, c.member_count, c.confidence AS template_confidence, coalesce(f.confidence, c.confidence, 0) AS rank_confidence
    FROM k LEFT JOIN authority_pages p ON p.page_key = k.page_key LEFT JOIN authority_profiles f ON f.page_key = k.page_key LEFT JOIN m ON m.page_key = k.page_key LEFT JOIN authority_clusters c ON c.template_key = coalesce(f.template_key, mk)
    WHERE contains(lower(coalesce(p.url, k.page_key)), '1') OR contains(lower(coalesce(p.title, '')), '1') OR contains(lower(k.page_key), '1')""",
)
def j10_authority_pages(spark: SparkSession, sf: str) -> DataFrame:
    return reports.authority_pages(*[fact(spark, sf, n) for n in _AUTHORITY], search="1")


@query("u2_page_keys", oracle_with(*_AUTHORITY) + "SELECT page_key FROM authority_profiles UNION SELECT page_key FROM authority_members UNION SELECT page_key FROM authority_regions")
def u2_page_keys(spark: SparkSession, sf: str) -> DataFrame:
    return reports.all_page_keys(*[fact(spark, sf, n) for n in ("authority_profiles", "authority_members", "authority_regions")])


@query("k26_region_evidence", oracle_with("authority_regions") + "SELECT page_key, region, round(coalesce(CASE WHEN confidence IS NOT NULL THEN greatest(0, least(1, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END)) END, 0) * 100 + coalesce(prominence, 0) * 25 + CASE WHEN visible THEN 10 ELSE 0 END + text_density * 10 - link_density * 8 - boilerplate * 12, 6) + 0 AS score FROM authority_regions")
def k26_region_evidence(spark: SparkSession, sf: str) -> DataFrame:
    score = reports.region_evidence(*map(F.col, ("confidence", "prominence", "visible", "text_density", "link_density", "boilerplate")))
    return fact(spark, sf, "authority_regions").select("page_key", "region", (F.round(score, 6) + 0.0).alias("score"))


_FAMILIES = "WITH f AS (SELECT p_brand AS template_key, split_part(p_type, ' ', 1) AS family, COUNT(*) n FROM part GROUP BY 1, 2), m AS (SELECT p_brand AS template_key, COUNT(*) AS members, COUNT(DISTINCT p_size) AS sizes FROM part GROUP BY 1) "


@query("k20_template_confidence", _FAMILIES + ", t AS (SELECT template_key, MAX(n) AS top FROM f GROUP BY 1) SELECT template_key, members, round(greatest(0.45, least(0.98, 0.45 + least(0.35, members * 0.08) + least(0.12, CAST(top AS DOUBLE) / members * 0.12) + least(0.08, sizes / 50.0 * 0.08))), 4)::DOUBLE AS confidence FROM m JOIN t USING (template_key)")
def k20_template_confidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("template_key"), F.split("p_type", " ")[0].alias("family"), "p_size")
    top = reports.histogram(rows, ["template_key"], "family", 1).select("template_key", F.col("n").alias("top"))
    each = rows.groupBy("template_key").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("p_size").alias("sizes"))
    return each.join(top, "template_key").select("template_key", "members", reports.cluster_confidence(F.col("members"), F.col("top") / F.col("members"), F.col("sizes") / 50).alias("confidence"))


@query("a18_histogram", _FAMILIES + "SELECT template_key, family, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY template_key ORDER BY n DESC, family) AS place FROM f) WHERE place <= 4")
def a18_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("template_key"), F.split("p_type", " ")[0].alias("family"))
    return reports.histogram(rows, ["template_key"], "family", 4)


@query("a27_confidence", oracle_with("authority_profiles") + "SELECT page_type, round(AVG(CASE WHEN confidence IS NOT NULL THEN greatest(0, least(1, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END)) END), 4) AS value, CASE WHEN AVG(confidence) IS NULL THEN 'unknown' WHEN round(AVG(CASE WHEN confidence IS NOT NULL THEN greatest(0, least(1, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END)) END), 4) >= 0.75 THEN 'high' WHEN round(AVG(CASE WHEN confidence IS NOT NULL THEN greatest(0, least(1, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END)) END), 4) >= 0.45 THEN 'medium' ELSE 'low' END AS label FROM authority_profiles GROUP BY 1")
def a27_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return reports.confidence_summary(fact(spark, sf, "authority_profiles"), ["page_type"])


_TYPED = "CASE WHEN regexp_matches(t, '\\bfaq\\b|frequently asked|common questions') THEN 'faq' WHEN regexp_matches(t, '\\bcompare\\b|\\bcomparison\\b|\\bversus\\b|\\bvs\\b') THEN 'comparison' WHEN regexp_matches(t, '\\bcalculator\\b|\\bestimator\\b|\\btool\\b|\\bconfigurator\\b') THEN 'tool' WHEN regexp_matches(t, '\\bproducts\\b|\\bcollection\\b|\\bcatalog\\b|shop all') THEN 'category' WHEN regexp_matches(t, '\\bpricing\\b|\\bbook demo\\b|\\bget started\\b|\\brequest quote\\b') THEN 'landing' WHEN has_article OR subheadings >= 2 THEN 'article' WHEN regexp_matches(t, '\\bproduct\\b') THEN 'product' ELSE 'unknown' END"


@query("k14_quick_types", oracle_with("typed_pages") + f", x AS (SELECT *, lower(concat_ws(' ', title, heading, body)) AS t FROM typed_pages) SELECT page_id, {_TYPED} AS page_type FROM x")
def k14_quick_types(spark: SparkSession, sf: str) -> DataFrame:
    return fact(spark, sf, "typed_pages").select("page_id", classify.quick_page_type(F.col("title"), F.col("heading"), F.col("body"), F.col("has_article"), F.col("subheadings")).alias("page_type"))


_INTENT = "CASE WHEN regexp_matches(lower(query), 'login|signin|sign up|contact|support|dashboard|portal') THEN 'Navigational' WHEN regexp_matches(lower(query), 'buy|price|cheap|software|tool|review|vs|compare|best|top|discount|coupon|order|purchase|hire|services|cost|pricing|deal|app|platform') THEN 'Commercial' WHEN regexp_matches(lower(query), 'how|what|guide|tutorial|why|when|where|who|tips|ideas|examples|learn|meaning|definition|can|is|does|ways|benefits|history|news|free') THEN 'Informational' WHEN contains(lower(query), 'acme-goods') OR contains(lower(query), 'acme goods') THEN 'Navigational' ELSE 'Informational' END"
_QUESTION = "split_part(regexp_replace(trim(lower(query)), '\\s+', ' ', 'g'), ' ', 1) IN ('who', 'what', 'where', 'when', 'why', 'how', 'is', 'are', 'do', 'does', 'can', 'could', 'should', 'would') OR contains(query, '?')"


@query("k4_intents_and_questions", oracle_with("asked_queries") + f"SELECT id, query, {_INTENT} AS intent, {_QUESTION} AS question FROM asked_queries")
def k4_intents_and_questions(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query")
    return fact(spark, sf, "asked_queries").select("id", "query", classify.query_intent(q, "https://www.acme-goods.example/").alias("intent"), classify.is_question(q).alias("question"))


# -- payloads -------------------------------------------------------------------------------------------------------------


@query("s5_analytics_pages", "WITH e AS (SELECT CAST(ts AS DATE) AS date, concat('/s', CAST(user_id % 4 AS VARCHAR), '/p', CAST(user_id % 30 AS VARCHAR)) AS page_key, event_id % 9 AS s, event_id % 5 AS u, event_id % 13 AS v, event_id % 3 AS c, CAST(event_id % 10 AS DOUBLE) / 10 AS b FROM events) SELECT date, page_key, CAST(SUM(s) AS BIGINT) AS sessions, CAST(SUM(u) AS BIGINT) AS total_users, CAST(SUM(v) AS BIGINT) AS page_views, CAST(SUM(c) AS BIGINT) AS event_count, round(CASE WHEN SUM(s) > 0 THEN SUM(b * s) / SUM(s) ELSE 0 END, 6) AS bounce_rate FROM e GROUP BY 1, 2")
def s5_analytics_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = providers.analytics_rows(fact(spark, sf, "analytics_payloads"), ["date", "page_path"], ["sessions", "total_users", "page_views", "bounce_rate", "event_count"])
    return rounded(providers.traffic_page_rows(rows), "bounce_rate")


@query("s6_analytics_dimensions", "SELECT CAST(ts AS DATE) AS date, concat('/s', CAST(user_id % 4 AS VARCHAR), '/p', CAST(user_id % 30 AS VARCHAR), '?u=', CAST(event_id AS VARCHAR)) AS dimension_value, 'landing' AS dimension, CAST(event_id % 9 AS DOUBLE) AS sessions, CAST(event_id % 10 AS DOUBLE) / 10 AS bounce_rate FROM events")
def s6_analytics_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    rows = providers.analytics_rows(fact(spark, sf, "analytics_payloads"), ["date", "dimension_value"], ["sessions", "total_users", "page_views", "bounce_rate", "event_count"])
    return rows.select("date", "dimension_value", F.lit("landing").alias("dimension"), "sessions", "bounce_rate")


@query("s7_assistant_rows", oracle_with("llm_referral_daily") + f", r AS (SELECT *, {_CLASS} FROM llm_referral_daily WHERE regexp_matches(lower(source), 'chatgpt|openai|claude|anthropic|perplexity|copilot|gemini|bard')) SELECT source, source_class, COUNT(*) AS n, CAST(SUM(sessions) AS BIGINT) AS sessions FROM r GROUP BY 1, 2")
def s7_assistant_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = providers.from_assistants(fact(spark, sf, "llm_referral_daily"))
    return rows.groupBy("source", classify.assistant_source(F.col("source")).alias("source_class")).agg(F.count(F.lit(1)).alias("n"), F.sum("sessions").alias("sessions"))


# -- jobs -----------------------------------------------------------------------------------------------------------------


@query("u3_stored_rows", oracle_with("jobs") + ", p AS (SELECT site, COUNT(*) n FROM jobs WHERE status = 'queued' GROUP BY 1 UNION ALL SELECT site, COUNT(*) FROM jobs WHERE priority > 5 GROUP BY 1 UNION ALL SELECT owner, COUNT(*) FROM jobs GROUP BY 1) SELECT site, CAST(SUM(n) AS BIGINT) AS stored_rows FROM p GROUP BY 1")
def u3_stored_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = fact(spark, sf, "jobs")
    return reports.stored_rows([rows.filter("status = 'queued'"), rows.filter("priority > 5"), rows.select(F.col("owner").alias("site"))], ["site"])


@query("u6_job_days", oracle_with("jobs") + ", r AS (SELECT site, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(created_at AS DATE) END AS s, CAST(created_at AS DATE) + CAST(id % 20 AS INT) AS e FROM jobs), c AS (SELECT site, greatest(coalesce(s, e), DATE '1996-03-01') AS a, least(e, DATE '1996-06-30') AS b FROM r) SELECT DISTINCT site, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM c WHERE a <= b")
def u6_job_days(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("created_at")
    rows = fact(spark, sf, "jobs").select("site", F.when(F.col("id") % 5 != 0, day).alias("start"), F.date_add(day, (F.col("id") % 20).cast("int")).alias("end"))
    return reports.job_days(rows, date(1996, 3, 1), date(1996, 6, 30), ["site"])


@query("a28_statuses", oracle_with("jobs") + ", j AS (SELECT site, CASE WHEN id % 13 = 0 THEN 'superseded' ELSE status END AS status FROM jobs) SELECT site, status, COUNT(*) AS jobs FROM j WHERE status <> 'superseded' GROUP BY 1, 2")
def a28_statuses(spark: SparkSession, sf: str) -> DataFrame:
    rows = fact(spark, sf, "jobs").withColumn("status", F.when(F.col("id") % 13 == 0, "superseded").otherwise(F.col("status")))
    return reports.status_histogram(rows, ["site"])


_ESTIMATED = """, j AS (SELECT id, owner AS site, CASE WHEN status = 'queued' AND id % 3 = 0 THEN 'retrying' ELSE status END AS status, created_at AS queued_at, TIMESTAMP '1998-08-01' - to_seconds(id % 300) AS started_at, seconds FROM jobs),
    t AS (SELECT site, CAST(floor(quantile_cont(seconds, 0.5) + 0.5) AS BIGINT) AS typical FROM j WHERE status = 'completed' GROUP BY 1), o AS (SELECT j.*, greatest(coalesce(typical, 30), 30) AS typical FROM j LEFT JOIN t USING (site) WHERE status <> 'completed'),
    r AS (SELECT *, greatest(0, typical - id % 300) AS remaining FROM o WHERE status = 'running'), h AS (SELECT site, list(remaining) AS l FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY remaining DESC, id) rn FROM r) WHERE rn <= 2 GROUP BY 1),
    w AS (SELECT o.*, row_number() OVER (PARTITION BY o.site ORDER BY queued_at, id) AS n, list_sort(list_concat(coalesce(l, CAST([] AS BIGINT[])), list_slice(CAST([0, 0] AS BIGINT[]), 1, 2 - len(coalesce(l, CAST([] AS BIGINT[])))))) AS f, CASE WHEN len(coalesce(l, CAST([] AS BIGINT[]))) >= 2 THEN 1 ELSE 0 END AS blocked FROM o LEFT JOIN h ON o.site = h.site WHERE status <> 'running')
    SELECT site, id, status, CAST(n + blocked AS INT) AS place, typical, CAST(f[(n - 1) % 2 + 1] + floor((n - 1) / 2) * typical AS BIGINT) AS wait FROM w UNION ALL SELECT site, id, status, 1, typical, 0 FROM r"""


@query("w5_estimates", oracle_with("jobs") + _ESTIMATED)
def w5_estimates(spark: SparkSession, sf: str) -> DataFrame:
    rows = fact(spark, sf, "jobs")
    now = F.lit("1998-08-01 00:00:00").cast("timestamp")
    rows = rows.select("id", F.col("owner").alias("site"), F.when((F.col("status") == "queued") & (F.col("id") % 3 == 0), "retrying").otherwise(F.col("status")).alias("status"), F.col("created_at").alias("queued_at"), F.timestamp_seconds(now.cast("long") - F.col("id") % 300).alias("started_at"), "seconds")
    return jobs.estimates(rows, now)


@query("j25_sites_to_refresh", oracle_with("jobs") + ", u AS (SELECT DISTINCT owner FROM jobs WHERE owner % 7 <> 0), n AS (SELECT owner, site FROM jobs WHERE status = 'queued' UNION SELECT owner, site FROM jobs WHERE status = 'running' UNION SELECT owner, site + 1 FROM jobs WHERE priority = 50 UNION SELECT owner, site FROM jobs WHERE seconds > 300), a AS (SELECT DISTINCT owner, site FROM jobs WHERE id % 5 < 3) SELECT n.owner, n.site FROM n WHERE owner IN (SELECT owner FROM u) AND EXISTS (SELECT 1 FROM a WHERE a.owner = n.owner AND a.site = n.site)")
def j25_sites_to_refresh(spark: SparkSession, sf: str) -> DataFrame:
    rows = fact(spark, sf, "jobs")
    lists = [rows.filter("status = 'queued'"), rows.filter("status = 'running'"), rows.filter("priority = 50").withColumn("site", F.col("site") + 1), rows.filter("seconds > 300")]
    return reports.fan_out(rows.filter("owner % 7 <> 0"), lists, rows.filter("id % 5 < 3"))


@query("w4_stale_jobs", oracle_with("jobs") + "SELECT id, owner, site, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY owner, site ORDER BY created_at DESC, id DESC) AS rank FROM jobs WHERE status = 'running') WHERE rank > 1")
def w4_stale_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.one_running(fact(spark, sf, "jobs")).select("id", "owner", "site", "rank")


_KIND = "CASE CAST(id % 3 AS INT) WHEN 0 THEN 'core' WHEN 1 THEN 'pages' ELSE 'dimensions' END"


@query("w3_work_order", oracle_with("jobs") + f", j AS (SELECT id, priority, CASE WHEN id % 6 = 0 THEN NULL ELSE created_at END AS created_at, {_KIND} AS kind FROM jobs WHERE status = 'queued') SELECT id, priority, kind FROM j ORDER BY priority DESC, CASE kind WHEN 'core' THEN 0 WHEN 'pages' THEN 1 ELSE 2 END, created_at ASC NULLS FIRST, id LIMIT 400")
def w3_work_order(spark: SparkSession, sf: str) -> DataFrame:
    """The next 400 jobs by priority, kind and age; those without a time first."""
    kind = F.when(F.col("id") % 3 == 0, "core").when(F.col("id") % 3 == 1, "pages").otherwise("dimensions")
    rows = fact(spark, sf, "jobs").filter("status = 'queued'").select("id", "priority", F.when(F.col("id") % 6 != 0, F.col("created_at")).alias("created_at"), kind.alias("kind"))
    rank = F.when(F.col("kind") == "core", 0).when(F.col("kind") == "pages", 1).otherwise(2)
    return rows.orderBy(*jobs.priority_order(rows, rank)).limit(400).select("id", "priority", "kind")


@query("o3_totals", oracle_with("page_query_daily") + f"SELECT 'pages' AS what, COUNT(DISTINCT page_key) AS n FROM page_query_daily WHERE {DAYS} UNION ALL SELECT 'pages and queries', COUNT(*) FROM (SELECT DISTINCT page_key, query FROM page_query_daily WHERE {DAYS})")
def o3_totals(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows a report has without its order and paging."""
    rows = fact(spark, sf, "page_query_daily")
    count = lambda what, *d: (r := SearchReport(START, END, d, (Filter("query", "notContains", "none"),))).plan({r.grain: rows}).agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    return count("pages", "page").unionByName(count("pages and queries", "page", "query"))


@query("w1_total_beside_rows", oracle_with("query_daily") + f", g AS (SELECT query, {SUMS} FROM query_daily WHERE {DAYS} GROUP BY 1) SELECT query, clicks, impressions, (SELECT COUNT(*) FROM g) AS total FROM g ORDER BY clicks DESC, impressions DESC, query LIMIT 7")
def w1_total_beside_rows(spark: SparkSession, sf: str) -> DataFrame:
    report, rows = SearchReport(START, END, ("query",), limit=7), fact(spark, sf, "query_daily")
    total = report.plan({"query_daily": rows}).agg(F.count(F.lit(1)).alias("total"))
    return report.page({"query_daily": rows}).select("query", "clicks", "impressions").join(F.broadcast(total))  # one row


_ADDRESSES = "SELECT p_partkey AS id, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('/k', CAST(p_partkey AS STRING)) END AS page_key, concat(CASE WHEN p_partkey % 3 = 0 THEN 'HTTPS://Shop.Example' WHEN p_partkey % 3 = 1 THEN 'http://a.example:8080' ELSE '' END, '/One/', CAST(p_size AS STRING), CASE WHEN p_partkey % 4 = 0 THEN '///' WHEN p_partkey % 4 = 1 THEN '?b=1#c' WHEN p_partkey % 4 = 2 THEN '/#x' ELSE '' END) AS url, CAST(p_size AS INT) AS n FROM {part}"


@query(
    "f3_addresses",
    "WITH a AS (" + _ADDRESSES.replace("{part}", "part") + """), h AS (SELECT *, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS head, regexp_replace(url, '^[A-Za-z]+://[^/?#]*', '') AS rest FROM a)
    SELECT id, coalesce(nullif(page_key, ''), url) AS effective_key, CASE WHEN head = '' THEN NULL ELSE lower(head) || regexp_replace(regexp_replace(rest, '[?#].*$', ''), '/+$', '') END AS crawl_url, CASE WHEN regexp_matches(rest, '^/[^/?#]+/[^/?#]') THEN '/One/' ELSE '/' END AS section,
    CASE WHEN n <= 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 8 THEN '4-8' WHEN n <= 16 THEN '9-16' ELSE '17+' END AS bucket FROM h""",
)
def f3_addresses(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.sql(_ADDRESSES, part=spark.read.parquet(f"{sf}/part.parquet"))
    return rows.select("id", keys.effective_key(F.col("page_key"), F.col("url")).alias("effective_key"), keys.crawl_url(F.col("url")).alias("crawl_url"), keys.section(keys.page_key(F.col("url"))).alias("section"), measures.bucket_count(F.col("n")).alias("bucket"))


@query(
    "d10_times",
    """SELECT event_id, CAST(epoch(TIMESTAMP '2024-02-10 00:00:00') - epoch(ts) AS DOUBLE) / 3600 AS age_hours, CAST(greatest(1, round(event_id % 90)) AS BIGINT) AS seconds, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(CAST(ts AS DATE) - CAST(isodow(ts) - 1 AS INT) AS DATE) AS week,
    CASE WHEN event_id % 5 = 0 THEN 'AUTH' WHEN event_id % 5 = 1 THEN 'QUOTA' WHEN event_id % 5 = 2 THEN 'DB' WHEN event_id % 5 = 3 THEN 'PROVIDER' ELSE 'UNKNOWN' END AS error FROM events""",
)
def d10_times(spark: SparkSession, sf: str) -> DataFrame:
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id")
    message = F.when(n % 5 == 0, "Error 401: Permission denied").when(n % 5 == 1, "Quota is gone").when(n % 5 == 2, "Deadlock found").when(n % 5 == 3, "fetch failed")
    later = F.timestamp_micros(F.unix_micros(ts) + (n % 90) * 1_000_000)
    as_of = F.lit("2024-02-10 00:00:00").cast("timestamp")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", dates.age_hours(ts, as_of).alias("age_hours"), dates.duration_seconds(ts, later).alias("seconds"), dates.month_of(F.to_date(ts)).alias("month"), dates.bucket(F.to_date(ts), "week", 2).alias("week"), classify.error_class(message).alias("error"))


@query("r21_monthly_compare", oracle_with("site_daily") + ", m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(SUM(clicks) AS BIGINT) AS clicks FROM site_daily WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' GROUP BY 1), b AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, CAST(SUM(clicks) AS BIGINT) AS clicks FROM site_daily WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-06-30' GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY month) n FROM m), y AS (SELECT *, row_number() OVER (ORDER BY month) n FROM b) SELECT CAST(x.n AS INT) AS place, x.month, x.clicks, coalesce(y.clicks, 0) AS previous_clicks FROM x LEFT JOIN y ON x.n = y.n")
def r21_monthly_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Months of a range beside those of the year before, by place."""
    from .operators import compare

    rows = fact(spark, sf, "site_daily")
    months = lambda y: rows.filter(F.col("date").between(date(y, 1, 1), date(y, 6, 30))).groupBy(dates.bucket(F.col("date"), "month").alias("month")).agg(F.sum("clicks").alias("clicks"))
    return compare.by_place(months(1996), months(1995), "month", ["clicks"])


@query("r23_query_series", oracle_with("page_query_daily") + ", a AS (SELECT date, COUNT(DISTINCT query) AS n FROM page_query_daily WHERE query <> '' AND date BETWEEN DATE '1996-03-01' AND DATE '1996-03-31' GROUP BY 1), b AS (SELECT date, COUNT(DISTINCT query) AS n FROM page_query_daily WHERE query <> '' AND date BETWEEN DATE '1996-02-01' AND DATE '1996-02-29' GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY date) p FROM a), y AS (SELECT *, row_number() OVER (ORDER BY date) p FROM b) SELECT CAST(x.p AS INT) AS place, x.date, x.n AS query_count, coalesce(y.n, 0) AS previous_query_count FROM x LEFT JOIN y ON x.p = y.p")
def r23_query_series(spark: SparkSession, sf: str) -> DataFrame:
    from .operators import compare

    rows = fact(spark, sf, "page_query_daily").filter("query <> ''")
    days = lambda m, d: rows.filter(F.col("date").between(date(1996, m, 1), date(1996, m, d))).groupBy("date").agg(F.count_distinct("query").alias("query_count"))
    return compare.by_place(days(3, 31), days(2, 29), "date", ["query_count"])


@query("g5_redirected_pages", oracle_with("crawl_pages") + f", r AS (SELECT crawl_order, url, CASE WHEN crawl_order % 6 = 0 THEN 'https://site.example/moved/' || CAST(crawl_order AS VARCHAR) || '?r=1' WHEN status_code IS NULL THEN NULL ELSE url END AS final_url, status_code FROM crawl_pages) SELECT crawl_order, {_key_sql('coalesce(final_url, url)')} AS page_key, status_code IS NULL AND crawl_order % 6 <> 0 AS failed FROM r")
def g5_redirected_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page goes by its final address; a failed one, without status, stays under the address that was asked for."""
    final = F.when(F.col("crawl_order") % 6 == 0, F.concat(F.lit("https://site.example/moved/"), F.col("crawl_order").cast("string"), F.lit("?r=1"))).when(F.col("status_code").isNotNull(), F.col("url"))
    return graph.fetched_pages(fact(spark, sf, "crawl_pages").withColumn("final_url", final)).select("crawl_order", "page_key", "failed")


@query("k23_page_tests", oracle_with("crawl_pages") + f", k AS (SELECT crawl_order, url, {_key_sql('url')} AS page_key, regexp_replace(regexp_replace(lower(coalesce(canonical_url, '')), '[#?].*$', ''), '/+$', '') AS home, regexp_replace(regexp_replace(lower(url), '[#?].*$', ''), '/+$', '') AS own, * EXCLUDE (crawl_order, url) FROM crawl_pages) SELECT crawl_order, coalesce(status_code BETWEEN 200 AND 299, false) AND NOT noindex AND NOT (home <> '' AND home <> own) AND NOT (word_count < 20 AND trim(coalesce(title, '')) = '' AND h1_text = '') AS indexable, true AS source_ok, word_count >= 120 AS target_ok FROM (SELECT *, CASE WHEN h1_count > 0 THEN 'h' ELSE '' END AS h1_text FROM k)")
def k23_page_tests(spark: SparkSession, sf: str) -> DataFrame:
    from .operators import links

    pages = fact(spark, sf, "crawl_pages").withColumns({"page_key": keys.page_key(F.col("url")), "h1_text": F.when(F.col("h1_count") > 0, "h").otherwise("")})
    return links.page_tests(pages).select("crawl_order", "indexable", "source_ok", "target_ok")


@query("s4_search_rows", "SELECT o_custkey AS page, false AS truncated, CAST(o_orderdate AS DATE) AS date, concat('q', CAST(o_custkey % 50 AS VARCHAR)) AS query, CAST(o_orderkey % 7 AS DOUBLE) AS clicks, CAST(o_orderkey % 90 AS DOUBLE) AS impressions, CAST(1 + o_orderkey % 9 AS DOUBLE) AS position FROM orders")
def s4_search_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of provider payloads; those without enough keys or numbers are rejected."""
    from .operators import merge

    valid, _ = merge.split_valid(providers.search_rows(fact(spark, sf, "search_payloads")), 2)
    return valid.select("page", "truncated", dates.provider_date(F.col("keys")[0]).alias("date"), F.col("keys")[1].alias("query"), "clicks", "impressions", "position")


@query("s16_rejected_rows", "SELECT o_custkey AS page, COUNT(*) AS rejected FROM orders GROUP BY 1")
def s16_rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    from .operators import merge

    return merge.split_valid(providers.search_rows(fact(spark, sf, "search_payloads")), 2)[1].groupBy("page").agg(F.count(F.lit(1)).alias("rejected"))


@query("s8_second_engine_rows", "SELECT CASE WHEN o_orderkey % 4 = 0 THEN DATE '2024-02-01' ELSE CAST(o_orderdate AS DATE) END AS date, concat('q', CAST(o_custkey % 50 AS VARCHAR)) AS query, CAST(o_orderkey % 90 AS BIGINT) AS impressions, CAST(o_orderkey % 7 AS BIGINT) AS clicks, CAST(2 AS DOUBLE) AS click_position, CAST(3 AS DOUBLE) AS impression_position, CASE WHEN o_orderkey % 4 = 0 THEN 'fetched' ELSE 'reported' END AS date_source FROM orders")
def s8_second_engine_rows(spark: SparkSession, sf: str) -> DataFrame:
    return providers.engine2_rows(fact(spark, sf, "engine2_payloads"))


@query("s13_allowed_paths", "WITH p AS (SELECT concat('site', CAST(n_nationkey AS VARCHAR), '.example') AS site, n_nationkey % 4 AS k, concat('/s', CAST(s_suppkey % 5 AS VARCHAR), '/p', CAST(s_suppkey % 20 AS VARCHAR)) AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT DISTINCT site, path, NOT starts_with(path, concat('/s', CAST(k AS VARCHAR))) OR starts_with(path, concat('/s', CAST(k AS VARCHAR), '/p1')) AS allowed FROM p")
def s13_allowed_paths(spark: SparkSession, sf: str) -> DataFrame:
    rules = providers.robots_rules(fact(spark, sf, "robots_files"))
    n = F.col("s_suppkey")
    paths = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("site"), F.col("s_nationkey").cast("string"), F.lit(".example")).alias("site"), F.concat(F.lit("/s"), (n % 5).cast("string"), F.lit("/p"), (n % 20).cast("string")).alias("path")).distinct()
    return providers.allowed(paths, rules)


@query("s12_robots_rules", "SELECT concat('site', CAST(n_nationkey AS VARCHAR), '.example') AS site, unnest(['disallow', 'allow', 'sitemap']) AS kind, unnest([concat('/s', CAST(n_nationkey % 4 AS VARCHAR)), concat('/s', CAST(n_nationkey % 4 AS VARCHAR), '/p1'), 'https://site.example/map.xml']) AS value FROM nation")
def s12_robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    return providers.robots_rules(fact(spark, sf, "robots_files"))


@query("g4_orphans", f"SELECT page_key, resolved_key FROM ({ORACLE['g2_inbound_resolved']}) WHERE inbound = 0")
def g4_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return graph.orphans(QUERIES["g2_inbound_resolved"](spark, sf)).select("page_key", "resolved_key")


# -- ingest ---------------------------------------------------------------------------------------------------------------

_RESTATED = "date BETWEEN DATE '1996-03-05' AND DATE '1996-04-10'"


def _ingested(spark: SparkSession, sf: str, dataset: str) -> DataFrame:
    """Two runs into one warehouse: days before 1998 as provider rows, then some days again with other clicks."""
    rows = fact(spark, sf, "page_query_daily").filter("date < DATE '1998-01-01'")
    payload = lambda d: d.select(F.array(F.col("date").cast("string"), "page_key", "query").alias("keys"), "clicks", "impressions", F.lit(0.5).alias("ctr"), "position")
    named = lambda d: d.select(F.to_date(F.col("keys")[0]).alias("date"), F.col("keys")[1].alias("page_key"), F.col("keys")[2].alias("query"), "clicks", "impressions", "position")
    at = (spark.sparkContext.applicationId, sf)
    if at not in _WAREHOUSES:
        made = ingest.Warehouse(spark, f"{shared_root(spark)}/sitelode/warehouse-{uuid.uuid4().hex}")
        made.ingest(payload(rows), 3, named, "first")
        made.ingest(payload(rows.filter(_RESTATED).withColumn("clicks", F.col("clicks") + 100)), 3, named, "restated")
        _WAREHOUSES[at] = made
    return _WAREHOUSES[at].read(dataset)


_WAREHOUSES: dict[tuple[str, str], ingest.Warehouse] = {}
_BROUGHT = oracle_with("page_query_daily") + f", r AS (SELECT date, page_key, query, clicks + CASE WHEN {_RESTATED} THEN 100 ELSE 0 END AS clicks, impressions, position FROM page_query_daily WHERE date < DATE '1998-01-01') "


@query("s15_ingested_pages", _BROUGHT + f"SELECT date, page_key, {SUMS}, {POSITION}, COUNT(DISTINCT query) AS query_count FROM r GROUP BY 1, 2")
def s15_ingested_pages(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_ingested(spark, sf, "pages"), "position")


@query("s15_ingested_months", _BROUGHT + f"SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, page_key, query, {SUMS}, round(SUM(position * impressions), 3) AS position_sum FROM r GROUP BY 1, 2, 3")
def s15_ingested_months(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_ingested(spark, sf, "months"), "position_sum", digits=3)
