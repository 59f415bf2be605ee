"""Provider payloads, robots rules, sitemaps, and export."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import provider_date
from ..functions.keys import page_key
from ..functions.measures import floored_mean, number, safe_ratio

SEARCH_ROW = "struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>"
ENGINE2_ROW = "struct<Query:string,Date:string,Impressions:double,Clicks:double,AvgClickPosition:double,AvgImpressionPosition:double>"


def search_rows(payloads: DataFrame, column: str = "payload", page_size: int = 25_000) -> DataFrame:
    """Rows of ``{"rows": [...]}`` payloads, with ``truncated`` where a page is full."""
    parsed = payloads.withColumn("_p", F.from_json(column, f"struct<rows:array<{SEARCH_ROW}>>"))
    full = F.coalesce(F.size("_p.rows") >= page_size, F.lit(False))
    return parsed.withColumn("truncated", full).select(*[c for c in payloads.columns if c != column], "truncated", F.explode("_p.rows").alias("_r")).select("*", "_r.*").drop("_r")


ANALYTICS_ROW = "struct<dimensionValues:array<struct<value:string>>,metricValues:array<struct<value:string>>>"
# Fixed value: sources of the assistants, lower-cased.
ASSISTANT_SOURCES = r"chatgpt|openai|claude|anthropic|perplexity|copilot|bing\.com/chat|gemini|bard|ai\.google|google.*ai|you\.com|phind|mistral|meta.*ai|grok|x\.com/i/grok"


def analytics_rows(payloads: DataFrame, dimensions: list[str], metrics: list[str], column: str = "payload") -> DataFrame:
    """Rows of ``{"rows": [...]}`` payloads whose dimensions and metrics stand in order: a text column for each dimension
    (``date`` as a day), a number for each metric. A payload that cannot be read gives no rows; what is no number is 0."""
    rows = payloads.select(*[c for c in payloads.columns if c != column], F.explode(F.from_json(column, f"struct<rows:array<{ANALYTICS_ROW}>>").getField("rows")).alias("_r"))
    at = lambda kind, i: F.try_element_at(F.col(f"_r.{kind}"), F.lit(i + 1)).getField("value")
    named = [(provider_date(at("dimensionValues", i)) if d == "date" else F.coalesce(at("dimensionValues", i), F.lit(""))).alias(d) for i, d in enumerate(dimensions)]
    return rows.select(*rows.columns[:-1], *named, *[number(at("metricValues", i)).alias(m) for i, m in enumerate(metrics)])


def traffic_page_rows(rows: DataFrame) -> DataFrame:
    """One row for each day and page key; paths with one key are summed, their bounce rates weighted by sessions."""
    keyed = rows.withColumn("page_key", page_key(F.when(F.col("page_path") == "", "/").otherwise(F.col("page_path"))))
    sums = [F.sum(c).cast("long").alias(c) for c in ("sessions", "total_users", "page_views", "event_count")]
    return keyed.groupBy("date", "page_key").agg(*sums, safe_ratio(F.sum(F.col("bounce_rate") * F.col("sessions")), F.sum("sessions")).alias("bounce_rate"))


def from_assistants(rows: DataFrame, source: str = "source") -> DataFrame:
    """The rows whose source is an assistant."""
    return rows.filter(F.lower(source).rlike(ASSISTANT_SOURCES))


def engine2_rows(payloads: DataFrame, column: str = "payload", fetched: str = "fetched_date") -> DataFrame:
    """Rows of ``{"d": [...]}`` payloads; a row without a date takes the day it was fetched and says so."""
    parsed = payloads.select(fetched, F.explode(F.from_json(column, f"struct<d:array<{ENGINE2_ROW}>>").getField("d")).alias("r"))
    day = provider_date(F.col("r.Date"))
    number = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0.0))
    return parsed.filter(F.trim(F.coalesce("r.Query", F.lit(""))) != "").select(F.coalesce(day, F.col(fetched)).alias("date"), F.trim("r.Query").alias("query"), number("Impressions").cast("long").alias("impressions"), number("Clicks").cast("long").alias("clicks"), number("AvgClickPosition").alias("click_position"), number("AvgImpressionPosition").alias("impression_position"), F.when(day.isNull(), "fetched").otherwise("reported").alias("date_source"))


def engine2_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums, and mean positions under weights of at least 1."""
    return rows.groupBy(*keys).agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), safe_ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr"), floored_mean(F.col("click_position"), F.col("clicks")).alias("click_position"), floored_mean(F.col("impression_position"), F.col("impressions")).alias("impression_position"))


def robots_rules(robots: DataFrame, column: str = "robots") -> DataFrame:
    """site, kind, value of the group for all agents: allow, disallow and sitemap lines after ``User-agent: *``."""
    lines = robots.select("site", F.posexplode(F.split(column, r"\r?\n")).alias("i", "_line")).withColumn("_line", F.trim("_line")).filter("_line <> '' and not startswith(_line, '#')")
    pair = lines.select("site", "i", F.lower(F.trim(F.regexp_extract("_line", r"^([^:]*)", 1))).alias("kind"), F.trim(F.regexp_extract("_line", r"^[^:]*:(.*)$", 1)).alias("value"))
    # the agent line that governs each line: one robots file is one small group
    agents = pair.filter("kind = 'user-agent'").groupBy("site").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("agents"))
    governed = pair.filter(F.col("kind").isin("allow", "disallow", "sitemap") & (F.col("value") != "")).join(agents, "site")
    last = F.element_at(F.filter("agents", lambda a: a["i"] < F.col("i")), -1)
    return governed.filter(F.size(F.filter("agents", lambda a: a["i"] < F.col("i"))) > 0).filter(last["value"] == "*").select("site", "kind", "value")


def allowed(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """site, path, allowed: the longest matching prefix decides, and allow wins ties; no match allows."""
    per_site = rules.groupBy("site").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("allow", "disallow")])
    longest = lambda c: F.coalesce(F.array_max(F.transform(F.filter(c, lambda r: F.startswith(F.col("path"), r)), F.length)), F.lit(-1))
    return paths.join(per_site, "site", "left").select("site", "path", (longest("allow") >= longest("disallow")).alias("allowed"))


def sitemap_urls(maps: DataFrame, column: str = "xml") -> DataFrame:
    """site, url, is_map of sitemaps and sitemap indexes on the site's own host."""
    bare = F.regexp_replace(column, r'\sxmlns="[^"]*"', "")
    found = maps.select("site", F.explode(F.xpath(bare, F.lit("//loc/text()"))).alias("url"), bare.contains("<sitemapindex").alias("is_map")).withColumn("url", F.trim("url"))
    host = F.regexp_extract("url", r"^https?://(?:www\.)?([^/:]+)", 1)
    return found.filter(host == F.regexp_replace("site", r"^www\.", "")).distinct()


def expand_sitemaps(seeds: DataFrame, fetched: DataFrame, depth: int = 3, most_maps: int | None = 1000, most_urls: int | None = 50_000) -> DataFrame:
    """site, url of the pages that the ``seeds`` (site, url) lead to through sitemap indexes, by ``fetched`` (site, map_url,
    xml): level by level, each map once, and of each site at most so many maps and pages, the lesser addresses first. The
    two bounds are the crawler's own, and None lifts them; a level is a join."""
    level = seeds.select("site", F.col("url").alias("map_url")).distinct()
    seen, found = level, []
    for _ in range(depth):
        links = sitemap_urls(level.join(fetched, ["site", "map_url"]))
        found.append(links.filter("not is_map").select("site", "url"))
        level = links.filter("is_map").select("site", F.col("url").alias("map_url")).distinct().join(seen, ["site", "map_url"], "left_anti")
        level = _first(level, "map_url", most_maps)
        seen = seen.unionByName(level)
    return _first(reduce(DataFrame.unionByName, found).distinct(), "url", most_urls)


def _first(rows: DataFrame, column: str, most: int | None) -> DataFrame:
    if most is None:
        return rows
    own = Window.partitionBy("site").orderBy(column)
    return rows.withColumn("_rn", F.row_number().over(own)).filter(F.col("_rn") <= most).drop("_rn")


def export_columns(grid: DataFrame, dimension: str) -> DataFrame:
    """Report columns as text: rates with two decimals and a percent sign, positions with one. A number is rounded by its
    binary value, as C does; the JVM rounds its shortest decimal form, so that 4.085 would give 4.09 in place of 4.08."""

    @F.pandas_udf("string")
    def shown(values: pd.Series, digits: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else f"{v:.{n}f}" for v, n in zip(values, digits, strict=True)], dtype=object)

    ctr = F.concat(shown(F.col("ctr") * 100, F.lit(2)), F.lit("%"))
    return grid.select(F.col(dimension), F.col("clicks").cast("string"), F.col("impressions").cast("string"), ctr.alias("ctr"), shown(F.col("position").cast("double"), F.lit(1)).alias("position"))


def write_csv(grid: DataFrame, path: str) -> None:
    grid.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
