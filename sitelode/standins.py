"""Stand-ins: the engine's facts, built from the supplied tables by SQL that Spark and DuckDB both run.

``{name}`` stands for a supplied table. Facts have whole-number measures, and ``position_sum`` is additive.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "page_query_daily": """SELECT CAST(l_shipdate AS DATE) AS date, concat('/s', CAST(l_suppkey % 3 AS STRING), '/p', CAST(l_suppkey % 25 AS STRING)) AS page_key,
        concat('part ', CAST(l_partkey % 60 AS STRING)) AS query, SUM(CAST(floor(l_quantity * l_discount) AS BIGINT)) AS clicks, SUM(CAST(l_quantity AS BIGINT)) AS impressions,
        CAST(SUM(CAST(l_quantity AS BIGINT) * (1 + CAST(round(l_tax * 100) AS BIGINT))) AS DOUBLE) / SUM(CAST(l_quantity AS BIGINT)) AS position
        FROM {lineitem} GROUP BY 1, 2, 3""",
    "product_queries": """SELECT CAST(l_shipdate AS DATE) AS date, concat('/s', CAST(l_suppkey % 5 AS STRING), '/p', CAST(l_suppkey % 40 AS STRING)) AS page_key, lower(concat(p_type, CASE WHEN l_linenumber % 2 = 0 THEN ' guides' ELSE '' END)) AS query,
        CAST(floor(l_quantity * l_discount) AS BIGINT) AS clicks, CAST(l_quantity AS BIGINT) AS impressions, CAST(1 + l_tax * 100 AS DOUBLE) AS position FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "query_daily": """SELECT CAST(l_shipdate AS DATE) AS date, concat('part ', CAST(l_partkey % 60 AS STRING)) AS query, SUM(CAST(floor(l_quantity * l_discount) AS BIGINT)) AS clicks,
        SUM(CAST(l_quantity AS BIGINT)) AS impressions, CAST(SUM(CAST(l_quantity AS BIGINT) * (1 + CAST(round(l_tax * 100) AS BIGINT))) AS DOUBLE) / SUM(CAST(l_quantity AS BIGINT)) AS position
        FROM {lineitem} GROUP BY 1, 2""",
    "country_daily": """SELECT CAST(l_shipdate AS DATE) AS date, concat(l_returnflag, l_linestatus) AS country, SUM(CAST(floor(l_quantity * l_discount) AS BIGINT)) AS clicks,
        SUM(CAST(l_quantity AS BIGINT)) AS impressions, CAST(SUM(CAST(l_quantity AS BIGINT) * (1 + CAST(round(l_tax * 100) AS BIGINT))) AS DOUBLE) / SUM(CAST(l_quantity AS BIGINT)) AS position
        FROM {lineitem} GROUP BY 1, 2""",
    "page_daily": """SELECT CAST(l_shipdate AS DATE) AS date, concat('/s', CAST(l_suppkey % 3 AS STRING), '/p', CAST(l_suppkey % 25 AS STRING)) AS page_key, SUM(CAST(floor(l_quantity * l_discount) AS BIGINT)) AS clicks,
        SUM(CAST(l_quantity AS BIGINT)) AS impressions, CAST(SUM(CAST(l_quantity AS BIGINT) * (1 + CAST(round(l_tax * 100) AS BIGINT))) AS DOUBLE) / SUM(CAST(l_quantity AS BIGINT)) AS position,
        COUNT(DISTINCT l_partkey % 60) AS query_count FROM {lineitem} GROUP BY 1, 2""",
    "site_daily": """SELECT CAST(l_shipdate AS DATE) AS date, SUM(CAST(floor(l_quantity * l_discount) AS BIGINT)) AS clicks, SUM(CAST(l_quantity AS BIGINT)) AS impressions,
        CAST(SUM(CAST(l_quantity AS BIGINT) * (1 + CAST(round(l_tax * 100) AS BIGINT))) AS DOUBLE) / SUM(CAST(l_quantity AS BIGINT)) AS position, COUNT(DISTINCT l_partkey % 60) AS query_count
        FROM {lineitem} GROUP BY 1""",
    "traffic_page_daily": """SELECT CAST(ts AS DATE) AS date, concat('/s', CAST(user_id % 4 AS STRING), '/p', CAST(user_id % 30 AS STRING)) AS page_key, COUNT(*) AS sessions, COUNT(DISTINCT user_id) AS total_users,
        SUM(1 + event_id % 3) AS page_views, CAST(SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS bounce_rate, SUM(event_id % 5) AS event_count FROM {events} GROUP BY 1, 2""",
    "traffic_dimension_daily": """SELECT CAST(ts AS DATE) AS date, 'event' AS dimension, event_type AS dimension_value, COUNT(*) AS sessions, COUNT(DISTINCT user_id) AS total_users, SUM(1 + event_id % 3) AS page_views,
        CAST(SUM(CASE WHEN value < 20 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS bounce_rate FROM {events} GROUP BY 1, 3""",
    "llm_referral_daily": """SELECT CAST(ts AS DATE) AS date, CASE CAST(user_id % 6 AS INT) WHEN 0 THEN 'chatgpt.com' WHEN 1 THEN 'perplexity.ai' WHEN 2 THEN 'Claude.ai' WHEN 3 THEN 'gemini.google.com' WHEN 4 THEN 'copilot' ELSE '' END AS source,
        concat('/s', CAST(user_id % 4 AS STRING)) AS page_key, COUNT(*) AS sessions, SUM(event_id % 2) AS engaged_sessions, CAST(SUM(event_id % 7) AS DOUBLE) AS key_events,
        CAST(SUM(event_id % 100) AS DOUBLE) / COUNT(*) AS average_session_duration FROM {events} GROUP BY 1, 2, 3""",
    "crawl_pages": """SELECT concat('https://www.site.example/s', CAST(p_partkey % 5 AS STRING), '/p', CAST(p_partkey % 900 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '?x=1' END) AS url,
        CASE WHEN p_partkey % 11 = 0 THEN concat('https://site.example/s1/p', CAST(p_partkey % 40 AS STRING)) WHEN p_partkey % 7 = 0 THEN 'https://other.example/z' END AS canonical_url,
        CASE WHEN p_partkey % 17 = 0 THEN 404 WHEN p_partkey % 19 = 0 THEN NULL ELSE 200 END AS status_code, p_partkey % 13 = 0 AS noindex, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS title,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS meta_description, CAST(p_size % 3 AS INT) AS h1_count, CAST(p_size * 20 AS BIGINT) AS word_count, CAST(p_partkey AS BIGINT) AS crawl_order
        FROM {part}""",
    "crawl_links": """SELECT DISTINCT concat('/s', CAST(o_custkey % 5 AS STRING), '/p', CAST(o_custkey % 40 AS STRING)) AS from_key, concat('/s', CAST(o_orderkey % 5 AS STRING), '/p', CAST(o_orderkey % 37 AS STRING)) AS to_key FROM {orders}""",
    "jobs": """SELECT o_orderkey AS id, o_custkey % 400 AS owner, o_orderkey % 11 AS site, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status,
        CASE WHEN o_orderpriority < '2' THEN 50 WHEN o_orderpriority < '4' THEN 20 ELSE 5 END AS priority, o_orderdate AS created_at, CAST(floor(o_totalprice / 1000) AS BIGINT) AS seconds FROM {orders}""",
    "access_log": """SELECT concat('10.0.', CAST(user_id % 250 AS STRING), '.', CAST(event_id % 250 AS STRING), ' - - [0', CAST(1 + event_id % 9 AS STRING), '/Jan/2024:1', CAST(event_id % 10 AS STRING), ':05:09 -0700] "',
        CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END, ' /s', CAST(user_id % 4 AS STRING), '/p', CAST(user_id % 30 AS STRING), ' HTTP/1.1" ', CASE WHEN event_id % 23 = 0 THEN '404' WHEN event_id % 41 = 0 THEN '500' ELSE '200' END, ' 512 "-" "',
        CASE CAST(user_id % 7 AS INT) WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' WHEN 1 THEN 'bingbot/2.0' WHEN 2 THEN 'GPTBot/1.0' WHEN 3 THEN 'PerplexityBot' WHEN 4 THEN 'my-crawler' WHEN 5 THEN '' ELSE 'Mozilla/5.0 (X11)' END, '"') AS line FROM {events}""",
    "scoped_daily": """SELECT CASE WHEN l_suppkey % 4 > 0 THEN concat('owner', CAST(l_suppkey % 4 AS STRING)) END AS owner, concat('https://site-', CAST(l_suppkey % 5 AS STRING), '.example') AS site, CAST(l_shipdate AS DATE) AS date,
        concat('/s', CAST(l_suppkey AS STRING), '/p', CAST(l_partkey % 50 AS STRING)) AS page_key, concat('part ', CAST(l_partkey AS STRING)) AS query, SUM(CAST(floor(l_quantity * l_discount) AS BIGINT)) AS clicks, SUM(CAST(l_quantity AS BIGINT)) AS impressions,
        CAST(SUM(CAST(l_quantity AS BIGINT) * (1 + CAST(round(l_tax * 100) AS BIGINT))) AS DOUBLE) / SUM(CAST(l_quantity AS BIGINT)) AS position FROM {lineitem} GROUP BY 1, 2, 3, 4, 5""",
    "scoped_traffic": """SELECT CASE WHEN l_suppkey % 4 > 0 THEN concat('owner', CAST(l_suppkey % 4 AS STRING)) END AS owner, concat('https://site-', CAST(l_suppkey % 5 AS STRING), '.example') AS site, CAST(l_shipdate AS DATE) AS date,
        concat('/s', CAST(l_suppkey AS STRING), '/p', CAST((l_partkey + 7) % 60 AS STRING)) AS page_key, SUM(CAST(l_quantity AS BIGINT)) AS sessions, SUM(CAST(l_quantity AS BIGINT) + l_linenumber) AS page_views, CAST(SUM(l_linenumber % 2) AS DOUBLE) / COUNT(*) AS bounce_rate FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "scoped_crawl": """SELECT CASE WHEN s % 4 > 0 THEN concat('owner', CAST(s % 4 AS STRING)) END AS owner, concat('https://site-', CAST(s % 5 AS STRING), '.example') AS site, concat('https://www.site.example/s', CAST(s AS STRING), '/p', CAST(p AS STRING), CASE WHEN p % 2 = 0 THEN '/' ELSE '?x=1' END) AS url,
        CASE WHEN p % 11 = 0 THEN concat('https://site.example/s', CAST(s AS STRING), '/p1') WHEN p % 7 = 0 THEN 'https://other.example/z' WHEN p % 13 = 0 THEN concat('https://site.example/s', CAST(s AS STRING), '/p', CAST(p + 40 AS STRING)) END AS canonical_url,
        CASE WHEN p % 17 = 0 THEN 404 WHEN p % 19 = 0 THEN NULL ELSE 200 END AS status_code, p % 23 = 0 AS noindex, CASE WHEN p % 5 = 0 THEN '' ELSE concat('Title ', CAST(p AS STRING)) END AS title, CASE WHEN p % 3 = 0 THEN NULL ELSE 'About it' END AS meta_description,
        CAST(p % 3 AS INT) AS h1_count, CAST(p * 20 AS BIGINT) AS word_count, CAST(s * 100 + p AS BIGINT) AS crawl_order FROM (SELECT DISTINCT l_suppkey AS s, l_partkey % 55 AS p FROM {lineitem}) AS x""",
    "scoped_links": """SELECT DISTINCT CASE WHEN l_suppkey % 4 > 0 THEN concat('owner', CAST(l_suppkey % 4 AS STRING)) END AS owner, concat('https://site-', CAST(l_suppkey % 5 AS STRING), '.example') AS site, concat('/s', CAST(l_suppkey AS STRING), '/p', CAST(l_partkey % 50 AS STRING)) AS from_key,
        concat('/s', CAST(l_suppkey AS STRING), '/p', CAST(l_orderkey % 53 AS STRING)) AS to_key FROM {lineitem}""",
    "authority_pages": """SELECT concat('/p', CAST(p_partkey AS STRING)) AS page_key, concat('https://site.example/p', CAST(p_partkey AS STRING)) AS url, p_name AS title FROM {part} WHERE p_partkey % 5 > 0""",
    "authority_profiles": """SELECT concat('/p', CAST(p_partkey AS STRING)) AS page_key, regexp_extract(p_type, '^([A-Z]+)', 1) AS page_type, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 100 AS DOUBLE) + 2 ELSE CAST(p_partkey % 100 AS DOUBLE) / 100 END AS confidence,
        CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS template_key FROM {part} WHERE p_partkey % 3 < 2""",
    "authority_members": """SELECT concat('/p', CAST(l_partkey AS STRING)) AS page_key, concat('Brand#', CAST(1 + l_suppkey % 5 AS STRING), CAST(1 + l_suppkey % 3 AS STRING)) AS template_key, CAST(l_linenumber AS DOUBLE) AS distance, CASE WHEN l_linenumber = 2 THEN true END AS is_exemplar FROM {lineitem} WHERE l_linenumber < 4""",
    "authority_clusters": """SELECT p_brand AS template_key, COUNT(*) AS member_count, CAST(COUNT(*) % 100 AS DOUBLE) / 100 AS confidence FROM {part} GROUP BY 1""",
    "authority_regions": """SELECT concat('/p', CAST(ps AS STRING)) AS page_key, region, confidence, prominence, visible, text_density, link_density, boilerplate FROM (SELECT l_partkey + 3 AS ps, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS region, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN CAST(l_suppkey % 150 AS DOUBLE) ELSE CAST(l_discount AS DOUBLE) END AS confidence,
        CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_tax AS DOUBLE) END AS prominence, l_returnflag = 'N' AS visible, CAST(l_discount AS DOUBLE) AS text_density, CAST(l_tax AS DOUBLE) AS link_density, CAST(l_linenumber AS DOUBLE) / 10 AS boilerplate FROM {lineitem}) x""",
    "typed_pages": """SELECT p_partkey AS page_id, p_name AS title, CASE CAST(p_partkey % 12 AS INT) WHEN 0 THEN 'Frequently asked about it' WHEN 1 THEN 'Compare both' WHEN 2 THEN 'One vs two' WHEN 3 THEN 'A calculator' WHEN 4 THEN 'Shop all' WHEN 5 THEN 'Pricing' WHEN 6 THEN 'The product' WHEN 7 THEN 'Stool and toolbox' WHEN 8 THEN 'New collection' ELSE p_type END AS heading,
        CASE WHEN p_partkey % 17 = 0 THEN 'our FAQ' WHEN p_partkey % 17 = 1 THEN 'faqs' WHEN p_partkey % 17 = 2 THEN NULL ELSE p_brand END AS body, p_partkey % 9 = 0 AS has_article, CAST(p_size % 4 AS INT) AS subheadings FROM {part}""",
    "asked_queries": """SELECT p_partkey AS id, concat(CASE CAST(p_partkey % 14 AS INT) WHEN 0 THEN 'How to clean ' WHEN 1 THEN 'buy ' WHEN 2 THEN 'sign up for ' WHEN 3 THEN 'acme goods ' WHEN 4 THEN 'Acme-Goods ' WHEN 5 THEN '  who made ' WHEN 6 THEN 'cheap ' WHEN 7 THEN 'could I use ' WHEN 8 THEN 'login ' WHEN 9 THEN 'meaning of ' ELSE '' END, lower(p_type), CASE WHEN p_partkey % 11 = 0 THEN ' price' WHEN p_partkey % 11 = 1 THEN '?' ELSE '' END) AS query FROM {part}""",
    "analytics_payloads": """SELECT event_id AS payload_id, concat('{{"rows":[{{"dimensionValues":[{{"value":"', replace(CAST(CAST(ts AS DATE) AS STRING), '-', ''), '"}},{{"value":"/s', CAST(user_id % 4 AS STRING), '/p', CAST(user_id % 30 AS STRING), '?u=', CAST(event_id AS STRING), '"}}],"metricValues":[{{"value":"', CAST(event_id % 9 AS STRING), '"}},{{"value":"', CAST(event_id % 5 AS STRING), '"}},{{"value":"', CAST(event_id % 13 AS STRING), '"}},{{"value":"0.', CAST(event_id % 10 AS STRING), '"}},{{"value":"', CAST(event_id % 3 AS STRING), '"}}]}}]}}') AS payload FROM {events}""",
    "search_payloads": """SELECT o_custkey AS page, concat('{{"rows":[{{"keys":["', CAST(CAST(o_orderdate AS DATE) AS STRING), '","q', CAST(o_custkey % 50 AS STRING), '"],"clicks":', CAST(o_orderkey % 7 AS STRING), ',"impressions":', CAST(o_orderkey % 90 AS STRING), ',"ctr":0.5,"position":', CAST(1 + o_orderkey % 9 AS STRING), '}},{{"keys":["none"]}}]}}') AS payload FROM {orders}""",
    "engine2_payloads": """SELECT DATE '2024-02-01' AS fetched_date, concat('{{"d":[{{"Query":" q', CAST(o_custkey % 50 AS STRING), ' ","Date":', CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE concat('"', CAST(CAST(o_orderdate AS DATE) AS STRING), '"') END, ',"Impressions":', CAST(o_orderkey % 90 AS STRING), ',"Clicks":', CAST(o_orderkey % 7 AS STRING), ',"AvgClickPosition":2,"AvgImpressionPosition":3}},{{"Query":" "}}]}}') AS payload FROM {orders}""",
    "robots_files": """SELECT concat('site', CAST(n_nationkey AS STRING), '.example') AS site, concat('User-agent: other', chr(10), 'Disallow: /', chr(10), '# comment', chr(10), 'User-Agent: *', chr(13), chr(10), 'Disallow: /s', CAST(n_nationkey % 4 AS STRING), chr(10), 'Allow: /s', CAST(n_nationkey % 4 AS STRING), '/p1', chr(10), 'Disallow:', chr(10), 'Sitemap: https://site.example/map.xml') AS robots FROM {nation}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", SQL[name]))
    return spark.sql(SQL[name], **{t: table(spark, sf_dir, t) for t in used})


def oracle_with(*names: str) -> str:
    """``WITH`` clause that defines stand-ins in DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({_plain(SQL[n])})" for n in names) + " "


def _plain(sql: str) -> str:
    """DuckDB knows the tables by name; doubled braces are single ones in a text."""
    return re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", sql).replace("{{", "{").replace("}}", "}")
