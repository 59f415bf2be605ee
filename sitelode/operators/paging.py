"""Pages far down an order, and places in it, without a task that sorts or takes everything.

Shallow pages are taken by Spark's own top-k. A deeper one cuts the rows into ranges of the order, one bucket each, counts
the buckets and reads those that the page meets. Later pages of the same ``Placed`` reuse its buckets. Where the last row of
the page before is known, ``after`` needs neither.

Nulls stand where Spark's order puts them: first in ascending, last in descending order. Rows that are equal in the whole
order get distinct places in some order, fixed once written. An empty table has no places.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored

#: Up to this many rows, offset and limit together, a task may hold the top of the order.
MOST_TAKEN = 50_000
BUCKET, INDEX = "_bucket", "_index"


@dataclass(frozen=True)
class Placed:
    """Rows by bucket, sorted inside: ``starts[b]`` rows come before bucket ``b``."""

    rows: DataFrame
    starts: tuple[int, ...]
    count: int

    def places(self, name: str = "place", first: int = 0, last: int | None = None) -> DataFrame:
        """The rows of buckets ``first`` to ``last`` with their places from 0. The broadcast has a row for each bucket."""
        last = len(self.starts) - 1 if last is None else last
        starts = self.rows.sparkSession.createDataFrame([(b, self.starts[b]) for b in range(first, last + 1)], f"{BUCKET} int, _start long")
        met = self.rows.filter(F.col(BUCKET).between(first, last)).join(F.broadcast(starts), BUCKET)
        return met.withColumn(name, F.col("_start") + F.col(INDEX)).drop(BUCKET, INDEX, "_start")

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in order."""
        first, last = (max(bisect_right(self.starts, p) - 1, 0) for p in (offset, offset + limit - 1))
        found = self.places("_place", first, last)
        return found.filter(F.col("_place").between(offset, offset + limit - 1)).orderBy("_place").drop("_place")


def place(rows: DataFrame, order: list[Column], buckets: int | None = None) -> Placed:
    """One exchange by ranges, written to the shared folder; as many buckets as shuffles have partitions."""
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # Spark numbers rows by partition in the upper bits and by row in the lower 33.
    numbered = cut.withColumn("_id", F.monotonically_increasing_id()).withColumns({INDEX: F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)), BUCKET: F.shiftright("_id", 33).cast("int")}).drop("_id")
    kept = stored(numbered, "placed", BUCKET)
    counts = {r[BUCKET]: r["count"] for r in kept.groupBy(BUCKET).count().collect()}
    ends = list(accumulate(counts.get(b, 0) for b in range(n)))
    return Placed(kept, (0, *ends[:-1]), ends[-1])


def paged(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    if offset + limit <= MOST_TAKEN:
        return rows.orderBy(*order).offset(offset).limit(limit)
    return place(rows, order).page(offset, limit)


def after(rows: DataFrame, keys: list[tuple[str, bool]], values: tuple, limit: int) -> DataFrame:
    """The next ``limit`` rows behind the row with ``values`` of the ``keys`` (column, descending), which tell rows apart."""
    beyond, same = F.lit(False), F.lit(True)
    for (name, down), value in zip(keys, values, strict=True):
        c = F.col(name)
        if value is None:
            next_ = F.lit(False) if down else c.isNotNull()
        else:
            next_ = (c < F.lit(value)) | c.isNull() if down else c > F.lit(value)
        beyond = beyond | (same & F.coalesce(next_, F.lit(False)))
        same = same & c.eqNullSafe(F.lit(value))
    return rows.filter(beyond).orderBy(*ordered(keys)).limit(limit)


def ordered(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.desc(name) if down else F.asc(name) for name, down in keys]
