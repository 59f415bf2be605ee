"""The link graph: degrees with canonical redirection, orphans, bounded breadth-first search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import page_key
from ..shared import stored
from .paging import place

#: Kinds of seeds, the first to come first.
SEED_KINDS = ("seed", "sitemap", "previous-crawl")


def inbound(links: DataFrame) -> DataFrame:
    """to_key, inbound: links from other pages."""
    return links.filter("from_key <> to_key").groupBy("to_key").agg(F.count(F.lit(1)).alias("inbound"))


def inbound_resolved(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``pages``: page_key, resolved_key. Links count for the canonical page of their target, and a page has the count of its canonical key."""
    target = pages.select(F.col("page_key").alias("to_key"), F.col("resolved_key").alias("_resolved")).distinct()
    counted = links.join(target, "to_key", "left").withColumn("_target", F.coalesce("_resolved", "to_key")).groupBy("_target").agg(F.count(F.lit(1)).alias("inbound"))
    return pages.join(counted, pages["resolved_key"] == counted["_target"], "left").select("page_key", "resolved_key", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def outbound(links: DataFrame) -> DataFrame:
    return links.groupBy("from_key").agg(F.count(F.lit(1)).alias("outbound"), F.count_distinct("to_key").alias("targets"))


def orphans(resolved: DataFrame) -> DataFrame:
    return resolved.filter("inbound = 0")


def reach(seeds: DataFrame, links: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """page_key, depth: pages within ``depth`` links of the seeds, at their least depth; the first ``most`` by depth and key.

    One join for each level; the levels are written, so no level computes an earlier one again."""
    seen = seeds.select("page_key").distinct().withColumn("depth", F.lit(0))
    seen = front = stored(seen, "reach")
    edges = links.select("from_key", F.col("to_key").alias("page_key")).distinct()
    for level in range(1, depth + 1):
        near = front.select(F.col("page_key").alias("from_key")).join(edges, "from_key").select("page_key").distinct()
        front = stored(near.join(seen.select("page_key"), "page_key", "left_anti").withColumn("depth", F.lit(level)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen if most is None else seen.orderBy("depth", "page_key").limit(most)


def frontier(seeds: DataFrame, links: DataFrame, depth: int, most: int | None = None, all_seeds: bool = False) -> DataFrame:
    """page_key, depth, discovered_from (the seed's kind, or ``link``), discovered_from_key (the parent, null for seeds), place:
    the pages that a crawl's queue takes in, in its order, ``most`` at most.

    ``seeds``: page_key, discovered_from, and place where a kind has an order (otherwise by key). ``links``: from_key, to_key,
    and position where a page's links have an order (otherwise by target). As in a queue, the first discovery of a page decides
    its depth and parent, parents are taken in the order of their places, and nothing is taken in once the budget is spent.
    With ``all_seeds`` every seed is taken in, and links only what the seeds leave of the budget.
    Each level is a join, a grouped minimum and an order cut into buckets; only the bucket counts come to the driver. Null keys
    are no pages; an unknown kind comes last."""
    kind = F.array_position(F.array(*map(F.lit, SEED_KINDS)), F.coalesce("discovered_from", F.lit("")))
    rank = F.struct(F.when(kind > 0, kind).otherwise(len(SEED_KINDS) + 1), *(["place"] if "place" in seeds.columns else []), "discovered_from")
    best = seeds.filter("page_key IS NOT NULL").groupBy("page_key").agg(F.min(rank).alias("_by"))
    found = best.select("page_key", F.lit(0).alias("depth"), F.col("_by.discovered_from").alias("discovered_from"), F.lit(None).cast("string").alias("discovered_from_key"), "_by")
    by_place = F.col("position") if "position" in links.columns else F.col("to_key")
    edges = links.filter("from_key <> to_key").select("from_key", F.col("to_key").alias("page_key"), by_place.alias("_position"))
    taken, levels = 0, []
    for level in range(depth + 1):
        placed = place(found, [F.col("_by"), F.col("page_key")])
        front = placed.places().drop("_by")
        left = None if most is None or (all_seeds and level == 0) else most - taken
        levels.append((front if left is None else front.filter(F.col("place") < left)).withColumn("place", F.col("place") + taken))
        taken += placed.count if left is None else min(placed.count, left)
        if level == depth or placed.count == 0 or (most is not None and taken >= most):
            break
        parents = levels[-1].select(F.col("page_key").alias("from_key"), F.col("place").alias("_parent"))
        met = edges.join(parents, "from_key").groupBy("page_key").agg(F.min(F.struct("_parent", "_position", "from_key")).alias("_by"))
        seen = reduce(DataFrame.unionByName, [rows.select("page_key") for rows in levels])
        found = met.join(seen, "page_key", "left_anti").select("page_key", F.lit(level + 1).alias("depth"), F.lit("link").alias("discovered_from"), F.col("_by.from_key").alias("discovered_from_key"), "_by")
    return reduce(DataFrame.unionByName, levels)


def fetched_pages(rows: DataFrame) -> DataFrame:
    """``rows``: url, final_url (null: not fetched), status_code. Adds page_key, that of the final address, and failed."""
    return rows.withColumns({"page_key": page_key(F.coalesce("final_url", "url")), "failed": F.col("status_code").isNull() & F.col("final_url").isNull()})
