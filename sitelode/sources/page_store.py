"""Page facts of all sources in one stored table, so that reports across sources need neither a join nor an exchange.

Search, traffic and crawl rows lie side by side: partitioned by source, site and month, bucketed by page key and sorted by
it in each bucket. A report names a site and a range, so partitions are pruned; the full outer join of the sources on the
page key is one aggregate over the bucketed scan, which needs no exchange, whatever the number of sources.

A bucket holds the keys of one hash value range for all sources. A page with very many rows (one for each query and day) is
read by one task of each report; ``buckets`` should be such that a bucket of a site and range fits a task, so it grows with
the rows. Rows are written by ``tasks`` tasks, each with whole buckets of some sites and months.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import weighted_mean
from ..operators.blend import keyed_crawl
from ..shared import shared_root

EVIDENCE = "status_code int, noindex boolean, title string, meta_description string, h1_count int, inbound long, depth int, word_count long"
SHAPE = f"owner string, date date, page_key string, query string, clicks long, impressions long, position double, sessions long, page_views long, bounce_rate double, resolved boolean, away int, url string, crawl_order long, evidence struct<{EVIDENCE.replace(' ', ':').replace(',:', ',')}>, source string, site string, month date"
SOURCES = ("search", "traffic", "crawl")


class PageStore:
    """One table in the shared folder. Rows are added by source; a day or crawl must be added once (see ``merge`` for
    replacing partitions)."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, name: str | None = None, tasks: int | None = None):
        self.spark = spark
        shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets, self.tasks = buckets or shuffled, max(tasks or 0, shuffled)
        self.name = name or f"sitelode_pages_{uuid.uuid4().hex}"
        self.path = f"{shared_root(spark)}/sitelode/{self.name}"

    def _add(self, rows: DataFrame, source: str, month: Column, site: str | None, owner: str | None) -> None:
        own = lambda c, value: F.col(c) if c in rows.columns else F.lit(value).cast("string")
        whole = rows.withColumns({"source": F.lit(source), "site": own("site", site), "owner": own("owner", owner), "month": month})
        fields = [x.rsplit(" ", 1) if "struct" not in x else x.split(" ", 1) for x in _fields(SHAPE)]
        shown = [(F.col(n) if n in whole.columns else F.lit(None)).cast(kind).alias(n) for n, kind in fields]
        # Spark's own bucket of a key: each bucket of a site and month goes to one task, so that it is one file.
        bucket = F.pmod(F.hash("page_key"), F.lit(self.buckets))
        dealt = whole.select(*shown).repartition(self.tasks, bucket, "site", "month")
        dealt.write.mode("append").partitionBy("source", "site", "month").bucketBy(self.buckets, "page_key").sortBy("page_key").option("path", self.path).saveAsTable(self.name)

    def add_search(self, daily: DataFrame, site: str | None = None, owner: str | None = None) -> PageStore:
        """date, page_key, query, clicks, impressions, position; site and owner where the rows have none."""
        self._add(daily.filter("page_key <> ''"), "search", F.trunc("date", "MM"), site, owner)
        return self

    def add_traffic(self, daily: DataFrame, site: str | None = None, owner: str | None = None) -> PageStore:
        """date, page_key, sessions, page_views, bounce_rate."""
        self._add(daily.filter("page_key <> ''"), "traffic", F.trunc("date", "MM"), site, owner)
        return self

    def add_crawl(self, pages: DataFrame, inbound: DataFrame, address: str, crawled: date, site: str | None = None, owner: str | None = None) -> PageStore:
        """A crawl's pages under their resolved keys; those that resolve to another key also under their own, for pages
        that have traffic of their own. ``inbound``: to_key and inbound, by site where both have one."""
        keyed, links = keyed_crawl(pages, address), inbound.withColumnRenamed("site", "_site")
        on = F.col("raw_key") == F.col("to_key")
        if "site" in pages.columns and "site" in inbound.columns:
            on &= F.col("site") == F.col("_site")
        keyed = keyed.join(links, on, "left")
        have = [f.split(" ")[0] for f in EVIDENCE.split(", ")]
        value = lambda n: F.coalesce("inbound", F.lit(0)) if n == "inbound" else F.col(n) if n in pages.columns else F.lit(None)
        evidence = F.struct(*[value(n).alias(n) for n in have])
        away = F.col("raw_key") != F.col("resolved_key")
        kinds = F.array(F.struct(F.lit(True).alias("resolved"), F.col("resolved_key").alias("page_key")), F.when(away, F.struct(F.lit(False).alias("resolved"), F.col("raw_key").alias("page_key"))))
        carried = [c for c in ("site", "owner") if c in pages.columns]
        rows = keyed.select(*carried, "url", "crawl_order", evidence.alias("evidence"), away.cast("int").alias("away"), F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
        self._add(rows.select("*", "k.*").drop("k").withColumn("date", F.lit(crawled)), "crawl", F.lit(crawled.replace(day=1)), site, owner)
        return self

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def daily(self, source: str, site: str, start: date, end: date, owner: str | None = None) -> DataFrame:
        """The rows of a source, site and owner in a range; only the partitions of its months are read."""
        months = F.col("month").between(start.replace(day=1), end.replace(day=1))
        return self.table.filter((F.col("source") == source) & (F.col("site") == site) & months).filter(F.col("date").between(start, end) & F.col("owner").eqNullSafe(F.lit(owner).cast("string")))

    def sides(self, site: str, start: date, end: date, crawled: date, owner: str | None = None) -> DataFrame:
        """The full outer join of the three sources by page key, as ``blend.judged`` takes it: one aggregate, no exchange."""
        months, is_crawl = F.col("month").between(start.replace(day=1), end.replace(day=1)), F.col("source") == "crawl"
        parts = (is_crawl & (F.col("month") == crawled.replace(day=1))) | (F.col("source").isin("search", "traffic") & months)
        rows = self.table.filter((F.col("site") == site) & parts).filter(F.col("owner").eqNullSafe(F.lit(owner).cast("string")))
        rows = rows.filter(F.col("date").between(start, end) | (is_crawl & (F.col("date") == F.lit(crawled))))
        search, traffic = F.col("source") == "search", F.col("source") == "traffic"
        main, moved = is_crawl & F.col("resolved"), is_crawl & ~F.col("resolved")
        first = lambda kind, *order: F.min_by(F.when(kind, F.col("evidence")), F.when(kind, F.struct(*order)))
        each = rows.groupBy("page_key").agg(
            F.bool_or(search).alias("has_search"),
            F.bool_or(traffic).alias("has_traffic"),
            F.bool_or(main).alias("_main"),
            F.bool_or(moved).alias("_moved"),
            F.sum("clicks").alias("clicks"),
            F.sum("impressions").alias("impressions"),
            weighted_mean(F.col("position"), F.col("impressions")).alias("position"),
            F.count_distinct(F.nullif("query", F.lit(""))).alias("query_count"),
            F.sum("sessions").alias("sessions"),
            F.sum("page_views").alias("page_views"),
            weighted_mean(F.col("bounce_rate"), F.col("sessions")).alias("bounce_rate"),
            first(main, "away", "url", "crawl_order").alias("_resolved_to"),
            first(moved, "url", "crawl_order").alias("_moved_from"),
            F.sum(F.when(main, F.col("away")).cast("long")).alias("_variants"),
        )
        by_traffic = F.col("has_traffic") & F.col("_moved") & ~F.col("_main")
        chosen = F.when(F.col("_main"), F.col("_resolved_to")).when(by_traffic, F.col("_moved_from"))
        variants = F.when(F.col("_main"), F.col("_variants")).when(by_traffic, F.lit(1).cast("long"))
        known = each.filter(F.col("has_search") | F.col("has_traffic") | F.col("_main"))
        shown = known.withColumns({"_e": chosen, "canonical_variants": variants, "has_crawl": F.col("_main") | by_traffic})
        return shown.select("*", "_e.*").drop("_e", "_main", "_moved", "_resolved_to", "_moved_from", "_variants")

    def drop(self) -> None:
        """Removes the table's name; its files stay in the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _fields(shape: str) -> list[str]:
    """Top-level fields of a shape."""
    out, depth, held = [], 0, ""
    for c in shape:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [*out, held.strip()]
