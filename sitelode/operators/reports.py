"""Report shapes over the facts: scopes, raw rows, traffic and referral reports, evidence of pages, job ranges."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import clamp, normal_confidence, safe_ratio, weighted_mean
from .paging import paged

# -- scopes ---------------------------------------------------------------------------------------------------------------


def in_scope(rows: DataFrame, owner: str | None, site: str) -> DataFrame:
    """Rows of one owner and site. Rows without an owner belong to no owner, so that None finds them."""
    return rows.filter(F.col("owner").eqNullSafe(F.lit(owner).cast("string")) & (F.col("site") == site))


def same_owner(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Joins on owner and keys; two missing owners are the same."""
    right = b.withColumnRenamed("owner", "_owner")
    return a.join(right.withColumnsRenamed({k: f"_{k}" for k in keys}), reduce(lambda x, k: x & (F.col(k) == F.col(f"_{k}")), keys, F.col("owner").eqNullSafe(F.col("_owner")))).drop("_owner", *[f"_{k}" for k in keys])


def preferred(scopes: DataFrame, sources: DataFrame, kinds: list[str]) -> DataFrame:
    """scope, kind, source: of each scope the source of the kind that comes first in ``kinds``; then the oldest, then the
    least. Scopes without a source stay, with nulls."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    own = Window.partitionBy("scope").orderBy(F.when(place > 0, place).otherwise(len(kinds) + 1), "created_at", "source")
    first = sources.withColumn("_rn", F.row_number().over(own)).filter("_rn = 1").select("scope", "kind", "source")
    return scopes.select("scope").distinct().join(first, "scope", "left")


# -- raw rows -------------------------------------------------------------------------------------------------------------


def _search_means() -> list[Column]:
    return [F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), safe_ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr"), weighted_mean(F.col("position"), F.col("impressions")).alias("position")]


def raw_search(rows: DataFrame, kind: str, start: date, end: date, search: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """Stored rows of a grain (``site``, ``query``, ``page_query``), newest first, or pages by clicks (``page``). ``search``
    is found anywhere, whatever its case; wild cards in it are plain characters."""
    keys = {"site": [], "query": ["query"], "page": ["page_key"], "page_query": ["page_key", "query"]}[kind]
    held = rows.filter(F.col("date").between(start, end))
    for k in keys:
        held = held.filter(F.col(k) != "")
    if search:
        places = [F.lower(k).contains(search.lower()) for k in keys] or [F.col("date").cast("string").contains(search.lower())]
        held = held.filter(reduce(lambda a, b: a | b, places))
    if kind == "page":
        found = held.groupBy("page_key").agg(*_search_means(), F.count_distinct("query").alias("query_count"))
        order = [F.desc("clicks"), F.desc("impressions"), F.asc("page_key")]
    else:
        found = held.select("date", *keys, "clicks", "impressions", safe_ratio(F.col("clicks"), F.col("impressions")).alias("ctr"), "position")
        order = [F.desc("date"), F.desc("clicks"), F.desc("impressions"), *map(F.asc, keys)]
    return paged(found, order, limit, offset)


def raw_traffic(rows: DataFrame, kind: str, search: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """Stored traffic rows, newest first (``page_date``), or sums by page (``page``)."""
    held = rows.filter(F.col("page_key") != "")
    if search:
        held = held.filter(F.lower("page_key").contains(search.lower()))
    if kind == "page_date":
        return paged(held, [F.desc("date"), F.desc("sessions"), F.desc("page_views"), F.col("page_key")], limit, offset)
    return paged(traffic_sums(held, ["page_key"]), [F.desc("sessions"), F.desc("page_views"), F.col("page_key")], limit, offset)


def raw_dimension(rows: DataFrame, dimension: str, search: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    held = rows.filter((F.col("dimension") == dimension) & (F.col("dimension_value") != ""))
    if search:
        held = held.filter(F.lower("dimension_value").contains(search.lower()))
    return paged(traffic_sums(held, ["dimension", "dimension_value"]), [F.desc("sessions"), F.desc("page_views"), F.col("dimension_value")], limit, offset)


# -- traffic and referrals ------------------------------------------------------------------------------------------------


def traffic_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("sessions", "total_users", "page_views", "event_count") if c in rows.columns]
    return rows.groupBy(*keys).agg(*sums, weighted_mean(F.col("bounce_rate"), F.col("sessions")).alias("bounce_rate"))


def traffic_report(rows: DataFrame, dimensions: tuple[str, ...], page: str | None = None) -> DataFrame:
    """By any of date and page_key; ``page`` keeps one page."""
    if set(dimensions) - {"date", "page_key"}:
        raise ValueError(f"dimensions {dimensions}")
    held = rows.filter(F.col("page_key") != "") if "page_key" in dimensions else rows
    return traffic_sums(held if page is None else held.filter(F.col("page_key") == page), list(dimensions))


def referral_report(rows: DataFrame, most: int = 500) -> dict[str, DataFrame]:
    """``rows``: date, source, source_class, page_key and measures. Sums by day, by source, by landing page (the first
    ``most`` by sessions) and in all."""
    known = rows.filter(F.col("source") != "")
    sums = [F.sum("sessions").alias("sessions"), F.sum("engaged_sessions").alias("engaged_sessions"), F.sum("key_events").alias("key_events"), weighted_mean(F.col("average_session_duration"), F.col("sessions")).alias("duration")]
    landing = known.filter(F.col("page_key") != "").groupBy("page_key", "source", "source_class").agg(*sums)
    return {
        "daily": known.groupBy("date").agg(F.sum("sessions").alias("sessions")),
        "source": known.groupBy("source", "source_class").agg(*sums),
        "landing": landing.orderBy(F.desc("sessions"), "page_key", "source").limit(most),
        "totals": known.agg(*sums, F.count_distinct("source").alias("sources"), F.count_distinct(F.nullif("page_key", F.lit(""))).alias("pages")),
    }


def top_queries(page_query: DataFrame, most: int = 6) -> DataFrame:
    """Page sums over page and query sums, with the ``most`` queries of most impressions in order."""
    pairs = page_query.filter(F.col("page_key") != "").groupBy("page_key", "query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("_weight"))
    ranked = pairs.withColumn("_named", F.col("query") != "").withColumn("_rn", F.row_number().over(Window.partitionBy("page_key", "_named").orderBy(F.desc("impressions"), "query")))
    first = F.when(F.col("_named") & (F.col("_rn") <= most), F.struct("_rn", "query"))
    return ranked.groupBy("page_key").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), safe_ratio(F.sum("_weight"), F.sum("impressions")).alias("position"), F.count(F.lit(1)).alias("query_count"), F.transform(F.array_sort(F.collect_list(first)), lambda x: x["query"]).alias("top_queries"))


# -- evidence of pages ----------------------------------------------------------------------------------------------------


def all_page_keys(*tables: DataFrame) -> DataFrame:
    """Every page key that any of the tables has, once."""
    return reduce(DataFrame.unionByName, [t.select("page_key") for t in tables]).distinct()


def authority_pages(pages: DataFrame, profiles: DataFrame, members: DataFrame, clusters: DataFrame, regions: DataFrame, search: str = "") -> DataFrame:
    """A row for each page key of profiles, template members or regions, with what the five tables know of it. The
    template is the profile's, else the least that the page is a member of."""
    member = members.groupBy("page_key").agg(F.min("template_key").alias("_member"), F.min("distance").alias("distance"), F.max(F.coalesce("is_exemplar", F.lit(False))).alias("is_exemplar"))
    profile = profiles.select("page_key", "page_type", "confidence", F.col("template_key").alias("_own"))
    cluster = clusters.select("template_key", "member_count", F.col("confidence").alias("template_confidence"))
    found = all_page_keys(profiles, members, regions).join(pages.select("page_key", "url", "title"), "page_key", "left").join(profile, "page_key", "left").join(member, "page_key", "left")
    found = found.withColumn("template_key", F.coalesce("_own", "_member")).drop("_own", "_member").join(cluster, "template_key", "left")
    if search:
        held = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(search.lower())
        found = found.filter(held(F.coalesce("url", "page_key")) | held(F.col("title")) | held(F.col("page_key")))
    return found.withColumn("rank_confidence", F.coalesce("confidence", "template_confidence", F.lit(0.0)))


def region_evidence(confidence: Column, prominence: Column, visible: Column, text_density: Column, link_density: Column, boilerplate: Column) -> Column:
    """How much a region speaks for its page; missing measures count nothing."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return z(normal_confidence(confidence)) * 100 + z(prominence) * 25 + F.when(visible, 10).otherwise(0) + z(text_density) * 10 - z(link_density) * 8 - z(boilerplate) * 12


def cluster_confidence(members: Column, family_share: Column, region_density: Column) -> Column:
    """Of a template: by members, by the share of its commonest address family, and by the regions that they share."""
    return F.round(clamp(0.45 + F.least(F.lit(0.35), members * 0.08) + F.least(F.lit(0.12), family_share * 0.12) + F.least(F.lit(0.08), region_density * 0.08), 0.45, 0.98), 4)


def confidence_summary(rows: DataFrame, keys: list[str], column: str = "confidence") -> DataFrame:
    """Mean of the values (those over 1 are percentages) and its label; ``unknown`` where there is none."""
    mean = F.round(F.avg(normal_confidence(F.col(column))), 4)
    out = rows.groupBy(*keys).agg(mean.alias("value"))
    return out.withColumn("label", F.when(F.col("value").isNull(), "unknown").when(F.col("value") >= 0.75, "high").when(F.col("value") >= 0.45, "medium").otherwise("low"))


def histogram(rows: DataFrame, keys: list[str], value: str, most: int | None = None) -> DataFrame:
    """Rows by key and value; with ``most``, the commonest of each key, ties to the lesser value."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    if most is None:
        return counted
    own = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counted.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= most)


# -- jobs -----------------------------------------------------------------------------------------------------------------


def stored_rows(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows that several tables hold together, by key."""
    parts = [t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) for t in tables]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("n").alias("stored_rows"))


def job_days(jobs: DataFrame, start: date, end: date, keys: list[str]) -> DataFrame:
    """The days of a range that the jobs' own ranges (start, end; a missing start is the end) touch, each once by key."""
    first, last = F.greatest(F.coalesce("start", "end"), F.lit(start)), F.least(F.col("end"), F.lit(end))
    return jobs.filter(first <= last).select(*keys, F.explode(F.sequence(first, last)).alias("date")).distinct()


def status_histogram(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs by status; those that another job has superseded do not count."""
    return jobs.filter(F.col("status") != "superseded").groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("jobs"))


def fan_out(users: DataFrame, site_lists: list[DataFrame], access: DataFrame) -> DataFrame:
    """owner, site to refresh: every site that any list names for a user, once, where the user has access."""
    named = reduce(DataFrame.unionByName, [s.select("owner", "site") for s in site_lists]).distinct()
    return named.join(users.select("owner").distinct(), "owner", "left_semi").join(access.select("owner", "site").distinct(), ["owner", "site"], "left_semi")
