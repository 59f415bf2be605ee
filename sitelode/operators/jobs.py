"""Work queues: who is next, how long the wait is, and how healthy the runtime looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import half_up, median_seconds, safe_ratio


def claim_order(jobs: DataFrame) -> DataFrame:
    """First queued job of each (owner, site) that runs none, owners with fewer running jobs first, then by age."""
    running = jobs.filter("status = 'running'")
    per_owner = running.groupBy("owner").agg(F.count(F.lit(1)).alias("running"))
    waiting = jobs.filter("status = 'queued'").join(running.select("owner", "site").distinct(), ["owner", "site"], "left_anti")
    first = Window.partitionBy("owner", "site").orderBy("created_at", "id")
    return waiting.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn").join(per_owner, "owner", "left").withColumn("running", F.coalesce("running", F.lit(0))).orderBy("running", "created_at", "id")


def priority_order(jobs: DataFrame, type_rank: Column | None = None) -> list[Column]:
    return [F.desc("priority"), *([type_rank] if type_rank is not None else []), F.asc_nulls_first("created_at"), F.asc("id")]


def one_running(jobs: DataFrame) -> DataFrame:
    """Running jobs of a site beyond its newest, which are stale."""
    own = Window.partitionBy("owner", "site").orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.filter("status = 'running'").withColumn("rank", F.row_number().over(own)).filter("rank > 1")


#: Spans of 1, 2, 4 ... days that ranges are made of; the largest are longer than a century.
LEVELS = 16


def spans_of_range(start: Column, end: Column) -> Column:
    """The fewest aligned spans that make up the days from ``start`` to ``end``: at most two of each length.

    At a level, the spans that lie wholly inside go from ``low`` to ``high`` - 1; the first is taken if it is odd, the last
    if it is even, since the next level's spans hold the others in pairs."""
    found = []
    for level in range(LEVELS):
        low, high = F.shiftright(F.unix_date(start) + ((1 << level) - 1), level), F.shiftright(F.unix_date(end) + 1, level)
        span = lambda n, level=level: F.struct(F.lit(level).alias("level"), n.cast("int").alias("n"))
        found += [F.when((low < high) & (low % 2 != 0), span(low)), F.when((low < high) & (high % 2 != 0), span(high - 1))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def spans_of_day(day: Column) -> Column:
    """The span of each length that holds a day."""
    return F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(F.unix_date(day), level).cast("int").alias("n")) for level in range(LEVELS)])


def covering(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """The existing job that covers each request (same owner and site, range within its own): exact ranges first, then
    running, retrying, queued, completed, the tightest, the newest.

    A request meets a job in the one span of the job's range that holds the request's first day, so a site with very many
    jobs is split by time, and only jobs that reach over that day meet the request. Both sides are dealt by the join: each
    row becomes several, which Spark's size estimate leaves out, so a broadcast would bring many times the table to the driver."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "retrying", 1).when(F.col("status") == "queued", 2).otherwise(3)
    asked = requests.withColumn("_span", F.explode(spans_of_day(F.col("want_start"))))
    known = jobs.withColumnRenamed("id", "job_id").withColumn("_span", F.explode(spans_of_range(F.col("start"), F.col("end"))))
    both = asked.join(known.hint("merge"), ["owner", "site", "_span"]).filter("end >= want_end")
    exact = ((F.col("start") == F.col("want_start")) & (F.col("end") == F.col("want_end"))).cast("int")
    own = Window.partitionBy("request_id").orderBy(exact.desc(), rank, F.desc("start"), F.asc("end"), F.desc("updated_at"), F.desc("job_id"))
    return both.withColumn("_rn", F.row_number().over(own)).filter("_rn = 1").select("request_id", "job_id")


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Place of each queued job in its site's queue; sites are the unit of waiting.

    A place is the number of the site's jobs of earlier days (a running sum over a table of day counts) and the place
    within the day, so that no task ranks a whole queue."""
    return _places(jobs.filter("status = 'queued'"), "created_at", "place")


def _places(jobs: DataFrame, at: str, name: str) -> DataFrame:
    """Adds the place of each row in its site by ``at`` and id."""
    dated = jobs.withColumn("_day", F.to_date(at))
    days = dated.groupBy("site", "_day").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("site").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(F.col("site").alias("_s"), F.col("_day").alias("_d"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("site", "_day").orderBy(at, "id")
    placed = dated.withColumn("_in", F.row_number().over(own)).join(before, F.col("site").eqNullSafe(F.col("_s")) & F.col("_day").eqNullSafe(F.col("_d")))
    return placed.withColumn(name, (F.col("_before") + F.col("_in")).cast("int")).drop("_s", "_d", "_before", "_in", "_day")


def waits(jobs: DataFrame, slots: int = 2, least: int = 30) -> DataFrame:
    """Seconds until each queued job of a workspace starts: jobs in order go to the slot that is free first.

    One small group for each workspace: its open jobs."""
    done = jobs.filter("status = 'completed'").groupBy("site").agg(median_seconds(F.col("seconds")).alias("typical"))
    queued = queue_positions(jobs).select("site", "id", "place").join(done, "site", "left").withColumn("typical", F.greatest(F.coalesce("typical", F.lit(least)), F.lit(least)))
    # With equal estimates the slots fill in turn, so the wait is a formula and no simulation is needed.
    return queued.withColumn("wait", F.floor((F.col("place") - 1) / slots) * F.col("typical"))


def estimates(jobs: DataFrame, now: Column, slots: int = 2, least: int = 30) -> DataFrame:
    """Place and seconds to wait of each running, queued and retrying job, with what the running ones have left.

    Jobs take ``typical`` seconds each (the median of the site's completed ones). A running job has that less the time
    since ``started_at`` left; at most ``slots`` run. A queued job takes the slot that is free first, so with the slots
    sorted by what is left, the n-th queued job waits for slot (n - 1) mod slots and whole rounds before it."""
    done = jobs.filter("status = 'completed'").groupBy("site").agg(median_seconds(F.col("seconds")).alias("typical"))
    open_jobs = jobs.filter(F.col("status").isin("running", "queued", "retrying")).join(done, "site", "left").withColumn("typical", F.greatest(F.coalesce("typical", F.lit(least)), F.lit(least)))
    left = F.greatest(F.lit(0), F.col("typical") - (now.cast("long") - F.col("started_at").cast("long")))
    running = open_jobs.filter("status = 'running'").withColumn("left", left)
    # the slots of a site: what its running jobs have left, the least first; the others are free
    first = running.withColumn("_rn", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("left"), "id"))).filter(F.col("_rn") <= slots)
    held = first.groupBy("site").agg(F.collect_list("left").alias("_left"))
    waiting = _places(open_jobs.filter("status <> 'running'"), "queued_at", "n").join(held, "site", "left")
    busy = F.coalesce("_left", F.array().cast("array<long>"))
    free = F.array_sort(F.concat(busy, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), slots - F.size(busy)))))
    wait = F.element_at(free, ((F.col("n") - 1) % slots + 1).cast("int")) + F.floor((F.col("n") - 1) / slots) * F.col("typical")
    blocked = F.when(F.size(busy) >= slots, 1).otherwise(0)
    queued = waiting.select("site", "id", "status", (F.col("n") + blocked).cast("int").alias("place"), "typical", wait.cast("long").alias("wait"))
    return queued.unionByName(running.select("site", "id", "status", F.lit(1).alias("place"), "typical", F.lit(0).cast("long").alias("wait")))


def workload(jobs: DataFrame, slots: int = 2) -> DataFrame:
    n = jobs.filter(F.col("status").isin("queued", "running")).groupBy("site").agg(F.count(F.lit(1)).alias("open"))
    return n.withColumn("state", F.when(F.col("open") == 0, "idle").when(F.col("open") <= slots, "normal").when(F.col("open") <= 2 * slots, "busy").otherwise("backlogged"))


def health(jobs: DataFrame) -> DataFrame:
    oldest = lambda s: F.min(F.when(F.col("status") == s, F.col("created_at")))
    return jobs.groupBy("owner").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "running", "completed")], oldest("queued").alias("oldest_queued"))


def spread(jobs: DataFrame) -> DataFrame:
    """Exact percentiles and fairness by status, from the counts of equal values, which are combined before the exchange."""
    counted = jobs.filter(F.col("seconds").isNotNull()).groupBy("status", "seconds").agg(F.count(F.lit(1)).alias("n"))
    p = F.percentile("seconds", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("n"))
    x, n = F.col("seconds").cast("double"), F.col("n")
    even = safe_ratio(F.pow(F.sum(x * n), F.lit(2.0)), F.sum(n) * F.sum(x * x * n))
    rounded = lambda x: half_up(x, 6)
    return counted.groupBy("status").agg(p.alias("_p"), rounded(even).alias("fairness")).select("status", *[rounded(F.col("_p")[i]).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "fairness")


def backoff(attempt: Column) -> Column:
    """Minutes until the next attempt."""
    return F.least(F.lit(30), attempt)


