"""Several sources on one page key: the blend with its insights, and the reconciliation with its flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import blend_insight
from ..functions.keys import folder, page_key, resolved_key
from ..functions.measures import safe_ratio, weighted_mean
from .paging import paged


def search_pages(page_query: DataFrame) -> DataFrame:
    return page_query.filter("page_key <> ''").groupBy("page_key").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), weighted_mean(F.col("position"), F.col("impressions")).alias("position"), F.count_distinct(F.nullif("query", F.lit(""))).alias("query_count"))


def traffic_pages(traffic: DataFrame) -> DataFrame:
    return traffic.filter("page_key <> ''").groupBy("page_key").agg(F.sum("sessions").alias("sessions"), F.sum("page_views").alias("page_views"), weighted_mean(F.col("bounce_rate"), F.col("sessions")).alias("bounce_rate"))


def keyed_crawl(pages: DataFrame, site: str) -> DataFrame:
    site_col = F.lit(site)
    return pages.withColumns({"raw_key": page_key(F.col("url")), "resolved_key": resolved_key(F.col("url"), F.col("canonical_url"), site_col)})


def crawl_evidence(pages: DataFrame, traffic: DataFrame, inbound: DataFrame, site: str) -> DataFrame:
    """A crawl row for each canonical key (the page that is its own canonical, else the least address), with the number
    of other pages that point there; and for raw keys that have traffic of their own, the same evidence with one variant."""
    keyed = keyed_crawl(pages, site).join(inbound, F.col("raw_key") == F.col("to_key"), "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    fields = ["status_code", "noindex", "title", "meta_description", "h1_count", "inbound", *(c for c in ("depth", "word_count") if c in pages.columns)]
    away = F.col("raw_key") != F.col("resolved_key")
    evidence = F.struct(*fields)
    # Grouped minima are combined before the exchange, so a page with very many variants is no hot key.
    best = keyed.groupBy(F.col("resolved_key").alias("page_key")).agg(F.min_by(evidence, F.struct(away.cast("int").alias("a"), "url", "crawl_order")).alias("e"), F.sum(away.cast("long")).alias("canonical_variants"))
    main = best.select("page_key", "e.*", "canonical_variants")
    moved = keyed.filter(away).groupBy(F.col("raw_key").alias("page_key")).agg(F.min_by(evidence, F.struct("url", "crawl_order")).alias("e"))
    moved = moved.select("page_key", "e.*", F.lit(1).cast("long").alias("canonical_variants"))
    moved = moved.join(traffic.select("page_key").distinct(), "page_key", "left_semi").join(main.select("page_key"), "page_key", "left_anti")
    return main.unionByName(moved)


def blend(search: DataFrame, traffic: DataFrame, crawl: DataFrame) -> DataFrame:
    """Full outer join of the three on page_key; every page once, with its insight and issue flag."""
    a = search.withColumn("has_search", F.lit(True))
    b = traffic.withColumn("has_traffic", F.lit(True))
    c = crawl.withColumn("has_crawl", F.lit(True))
    return judged(a.join(b, "page_key", "full_outer").join(c, "page_key", "full_outer"))


def judged(joined: DataFrame) -> DataFrame:
    """Pages with what each source has of them (null where it has nothing), with insight and issue flag."""
    joined = joined.fillna(False, ["has_search", "has_traffic", "has_crawl", "noindex"]).fillna(0, ["clicks", "impressions", "position", "query_count", "sessions", "page_views", "bounce_rate", "canonical_variants", "inbound"])
    none = lambda x: F.trim(F.coalesce(F.col(x), F.lit(""))) == ""
    rows = joined.withColumns(
        {
            "ctr": safe_ratio(F.col("clicks"), F.col("impressions")),
            "folder": folder(F.col("page_key")),
            "crawl_error": F.coalesce((F.col("status_code") > 0) & (F.col("status_code") != 200), F.lit(False)),
            "metadata_gap": F.col("has_crawl") & (none("title") | none("meta_description") | (F.coalesce("h1_count", F.lit(0)) != 1)),
        }
    )
    issue = ~F.col("has_crawl") | F.col("crawl_error") | F.col("metadata_gap") | F.col("noindex") | (F.col("canonical_variants") > 0)
    return rows.withColumn("_insight", blend_insight()).withColumns({"insight": F.col("_insight.label"), "severity": F.col("_insight.severity"), "crawl_issue": issue}).drop("_insight")


def blend_totals(blended: DataFrame) -> DataFrame:
    return blended.agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.sum("sessions").alias("sessions"),
        safe_ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr"),
        weighted_mean(F.col("position"), F.col("impressions")).alias("position"),
        weighted_mean(F.col("bounce_rate"), F.col("sessions")).alias("bounce_rate"),
        *[F.count_if(F.col(f"has_{x}")).alias(f"{x}_pages") for x in ("search", "traffic", "crawl")],
        F.count_if("crawl_issue").alias("issue_pages"),
    )


def top_folders(blended: DataFrame, most: int = 6) -> DataFrame:
    return blended.groupBy("folder").agg(F.count(F.lit(1)).alias("pages"), F.sum("clicks").alias("clicks"), F.sum("sessions").alias("sessions")).orderBy(F.desc("clicks"), F.desc("sessions"), "folder").limit(most)


def top_opportunities(blended: DataFrame, most: int = 4) -> DataFrame:
    weight = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 1).otherwise(0)
    return blended.withColumn("weight", weight).filter("weight > 0").orderBy(F.desc("weight"), F.desc("impressions"), F.desc("sessions"), "page_key").limit(most)


FLAGS = ("missing_in_crawl", "missing_in_search", "missing_in_traffic", "crawl_error", "noindex", "canonical_mismatch", "impressions_without_clicks")


def reconcile(search: DataFrame, traffic: DataFrame, crawl: DataFrame, traffic_complete: bool = True) -> DataFrame:
    """Flags per page, and a score that puts flagged and wanted pages first. Missing traffic counts only when its coverage is complete."""
    return reconciled(blend(search, traffic, crawl), traffic_complete)


def reconciled(blended: DataFrame, traffic_complete: bool = True) -> DataFrame:
    """``reconcile`` of blended rows."""
    rows = flagged(blended, traffic_complete)
    n = F.size("flags")
    score = n * F.lit(1e9) + F.col("impressions") * 100.0 + F.col("clicks") * 10.0 + F.col("sessions")
    return rows.select("page_key", "has_search", "has_traffic", "has_crawl", "clicks", "impressions", "sessions", F.array_join("flags", ",").alias("flags"), F.when(n == 0, "matched").otherwise("flagged").alias("status"), score.alias("score"))


def flagged(rows: DataFrame, traffic_complete: bool = True) -> DataFrame:
    """Blended rows with the list of their flags."""
    s, t, c = F.col("has_search"), F.col("has_traffic"), F.col("has_crawl")
    flags = {
        "missing_in_crawl": (s | t) & ~c,
        "missing_in_search": (t | c) & ~s,
        "missing_in_traffic": (s | c) & ~t & F.lit(traffic_complete),
        "crawl_error": c & (F.col("status_code").isNull() | (F.col("status_code") >= 400)),
        "noindex": F.col("noindex"),
        "canonical_mismatch": F.col("canonical_variants") > 0,
        "impressions_without_clicks": (F.col("impressions") >= 100) & (F.col("clicks") == 0),
    }
    return rows.withColumn("flags", F.filter(F.array(*[F.when(v, k) for k, v in flags.items()]), lambda x: x.isNotNull()))


def reasons(rows: DataFrame) -> DataFrame:
    """A row for each page and flag of ``flagged`` rows: label, tone and a sentence that says why."""
    seen = F.concat(F.format_number("impressions", 0), F.lit(" impressions"))
    variants = F.col("canonical_variants").cast("string")
    # Label and tone of each flag.
    found = {
        "missing_in_crawl": ("Not found by crawler", F.lit("warning"), F.when(F.col("has_search"), F.concat(seen, F.lit(", but the crawl lacks the page."))).otherwise(F.lit("Sessions, but the crawl lacks the page."))),
        "missing_in_search": ("No search visibility row", F.lit("neutral"), F.when(F.col("has_crawl"), F.lit("Crawled, but search has no row in the range.")).otherwise(F.lit("Sessions, but search has no row in the range."))),
        "missing_in_traffic": ("No GA4 landing-page match", F.lit("neutral"), F.lit("Known, but no landing page matches its path.")),
        "crawl_error": ("Crawler could not fetch page", F.lit("danger"), F.concat(F.lit("Status "), F.coalesce(F.col("status_code").cast("string"), F.lit("none")), F.lit("."))),
        "noindex": ("Indexability conflict", F.when(F.col("has_search"), "danger").otherwise("warning"), F.when(F.col("has_search"), F.concat(F.lit("Marked noindex, yet "), seen, F.lit("."))).otherwise(F.lit("Marked noindex."))),
        "canonical_mismatch": ("Canonical variants found", F.lit("warning"), F.concat(variants, F.when(F.col("canonical_variants") == 1, " variant").otherwise(" variants"), F.lit(" under this page."))),
        "impressions_without_clicks": ("SERP demand without clicks", F.lit("warning"), F.concat(seen, F.lit(" and no clicks."))),
    }
    rows = rows.select("*", F.posexplode("flags").alias("place", "flag"))
    pick = lambda i: F.coalesce(*[F.when(F.col("flag") == k, F.lit(v[i]) if i == 0 else v[i]) for k, v in found.items()])
    return rows.select("page_key", "place", "flag", pick(0).alias("label"), pick(1).alias("tone"), pick(2).alias("detail"))


#: What each status of the reconciliation list shows; any other shows all.
STATUS_FLAGS = {"missing-crawl": "missing_in_crawl", "missing-search": "missing_in_search", "missing-traffic": "missing_in_traffic", "crawl-errors": "crawl_error", "noindex": "noindex", "canonical": "canonical_mismatch"}


def with_status(rows: DataFrame, status: str) -> DataFrame:
    if status in ("issues", "matched"):
        return rows.filter(F.size("flags") > 0 if status == "issues" else F.size("flags") == 0)
    return rows.filter(F.array_contains("flags", STATUS_FLAGS[status])) if status in STATUS_FLAGS else rows


# -- the page list --------------------------------------------------------------------------------------------------------

SORTS = {"page": "page_key", "clicks": "clicks", "impressions": "impressions", "ctr": "ctr", "queries": "query_count", "sessions": "sessions", "page_views": "page_views", "bounce_rate": "bounce_rate", "crawl_status": "crawl_issue", "depth": "depth", "inlinks": "inbound", "word_count": "word_count"}


def page_list(blended: DataFrame, sort: str = "clicks", ascending: bool = False, search: str = "", only: str = "all", traffic: str = "all", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the blend in the user's order; an unknown sort is by clicks, an unknown filter shows all, and ties go to
    the lesser key. Missing numbers count 0."""
    shows: dict[str, Column] = {
        "crawl-errors": F.col("crawl_error"),
        "metadata-gaps": F.col("metadata_gap"),
        "indexability": F.col("noindex") | (F.col("canonical_variants") > 0),
        "canonical-mismatch": F.col("canonical_variants") > 0,
        "missing-search": ~F.col("has_search"),
        "noindex": F.col("noindex"),
        "not-crawled": ~F.col("has_crawl"),
    }
    rows = blended.filter(shows[only]) if only in shows else blended
    if traffic in ("with", "without"):
        rows = rows.filter(F.col("has_traffic") if traffic == "with" else ~F.col("has_traffic"))
    if search:
        rows = rows.filter(F.lower("page_key").contains(search.lower()))
    name = SORTS.get(sort, "clicks")
    key = F.lower("page_key") if name == "page_key" else F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return paged(rows, [key.asc() if ascending else key.desc(), F.col("page_key")], limit, offset)
