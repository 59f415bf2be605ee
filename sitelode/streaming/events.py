"""Event streams (an extension: the batch reports have no counterpart of it).

``windowed`` and ``sessions`` work on batch and streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import replace_partitions

LATE = "2 days"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; rows later than ``late`` drop from a stream."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    total = events.withWatermark("ts", late).groupBy(span, "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return total.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    total = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return total.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "events")


def refresh_days(stream: DataFrame, source: DataFrame, target: str, checkpoint: str, rebuild) -> StreamingQuery:  # noqa: ANN001
    """For each micro-batch, rebuilds the days that it touches from the whole source and replaces those partitions."""
    return _refresh(stream, source, target, checkpoint, rebuild, F.to_date("ts"), "date")


def refresh_months(stream: DataFrame, source: DataFrame, target: str, checkpoint: str, rebuild) -> StreamingQuery:  # noqa: ANN001
    """The same for whole months (``month_start``), so that a late or short batch never leaves half a month in a summary.
    ``rebuild`` gets the source's rows of the touched months and returns rows with month_start."""
    return _refresh(stream, source, target, checkpoint, rebuild, F.trunc("ts", "MM"), "month_start")


def _refresh(stream: DataFrame, source: DataFrame, target: str, checkpoint: str, rebuild, bucket: Column, name: str) -> StreamingQuery:  # noqa: ANN001
    def apply(batch: DataFrame, _: int) -> None:
        touched = batch.select(bucket.alias(name)).distinct()
        replace_partitions(rebuild(source.withColumn(name, bucket).join(touched, name, "left_semi")), target, name)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
