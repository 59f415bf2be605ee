"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash inside each source and ranked; the fractional rank ``(rank - u) / rows of the source``,
with a seeded ``u`` in [0, 1) for each source, spreads every source evenly over (0, 1], and many sources of few rows evenly
as well. Sorting all rows by it and cutting the order into equal runs gives shards whose mixture is that of the whole
table, up to one row per source and end of a shard, and whose row counts differ by one at most (law ``rows``).

No step ranks a whole source, or the whole table, in one task. Equal rows are first counted into one; a rank is the number
of rows in the earlier buckets (a running sum over a table of bucket counts) plus the running count inside the bucket;
buckets are hash prefixes for the first rank, and equal steps of the fractional rank, which is uniform, for the second.

Nulls: a null source is a source of its own, a null text has size 1 and the checksum of no bytes; the shuffle hashes id,
checksum and size, so rows with one id, or none, are spread. Repeated rows are all kept. An empty table gives no rows. Only
the id, text and source columns are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = "1729"
#: Hex digits of the shuffle key that name a bucket: 16**3 buckets for each source.
PREFIX = 3
#: Buckets of the fractional rank.
STEPS = 4096
#: Copies of one row that are unfolded at once.
RUN = 1 << 16


def interleave(docs: DataFrame, shards: int = 8, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, source, size, text_crc32, fraction, shard, slot."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    word = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), word(F.col("_id")), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    counted = rows.groupBy("_id", "_source", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies")).withColumn("_key", key).withColumn("_prefix", F.substring("_key", 1, PREFIX))
    ranked = _copied(_rank(counted, ["_source"], "_prefix", ["_key", "_id", "text_crc32", "size"], "_rank"))
    shift = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), word(F.col("_source")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    fraction = (F.col("_rank") - shift) / F.col("_rows").cast("double")
    placed = ranked.withColumn("fraction", fraction).withColumn("_step", F.floor(F.col("fraction") * STEPS).cast("int")).withColumn("_copies", F.lit(1).cast("long"))
    order = ["fraction", "_source", "_key", "_id", "text_crc32", "size"]
    total = _rank(placed.drop("_rows"), [], "_step", order, "_place")
    return _cut(total, shards).select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "text_crc32", "fraction", "shard", "slot")


def _rank(rows: DataFrame, keys: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Adds the rank among those of its keys of the first copy of each row (``name``), and their number (``_rows``)."""
    counts = rows.groupBy(*keys, bucket).agg(F.sum("_copies").alias("_n"))
    over = Window.partitionBy(*keys)  # at most one row for each bucket
    before = counts.select(
        *[F.col(k).alias(f"{k}_r") for k in keys],
        F.col(bucket).alias(f"{bucket}_r"),
        F.coalesce(F.sum("_n").over(over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(over).alias("_rows"),
    )
    on = F.lit(True)
    for k in [*keys, bucket]:
        on &= F.col(k).eqNullSafe(F.col(f"{k}_r"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("_inside", F.sum("_copies").over(inside) - F.col("_copies") + 1)
    return ranked.join(before, on).withColumn(name, F.col("_before") + F.col("_inside")).drop(*[f"{k}_r" for k in [*keys, bucket]], "_before", "_inside")


def _copied(ranked: DataFrame) -> DataFrame:
    """Each copy on a row of its own, with its own rank; runs of RUN, so that no array grows with the copies."""
    runs = ranked.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / RUN))))
    size = F.least(F.lit(RUN).cast("long"), F.col("_copies") - F.col("_run") * RUN)
    each = runs.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
    return each.withColumn("_rank", F.col("_rank") + F.col("_run") * RUN + F.col("_nth")).drop("_run", "_nth", "_copies")


def _cut(total: DataFrame, shards: int) -> DataFrame:
    """The first ``rows % shards`` shards take one row more than the rest."""
    place, least, more = F.col("_place") - 1, F.floor(F.col("_rows") / shards), F.col("_rows") % shards
    large = (least + 1) * more  # places in the larger shards
    shard = F.when(place < large, F.floor(place / (least + 1))).otherwise(more + F.floor((place - large) / F.greatest(least, F.lit(1))))
    start = F.when(F.col("shard") <= more, F.col("shard") * (least + 1)).otherwise(large + (F.col("shard") - more) * least)
    return total.withColumn("shard", shard.cast("int")).withColumn("slot", (place - start).cast("long"))
