"""Access logs: lines to columns, from files or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import bot_type

# Fixed value: the combined log format.
LINE = r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3})\s+(\d+|-)(?:\s+"([^"]*)")?(?:\s+"([^"]*)")?'


def parse(lines: DataFrame, column: str = "line", respect_zone: bool = False) -> DataFrame:
    """ts, ip, method, path, status, agent, bot_type of lines that match; the zone is ignored unless asked for."""
    g = lambda i: F.regexp_extract(column, LINE, i)
    stamp, request = g(2), F.split(g(3), r"\s+")
    ts = F.try_to_timestamp(stamp, F.lit("dd/MMM/yyyy:HH:mm:ss Z")) if respect_zone else F.try_to_timestamp(F.regexp_replace(stamp, r"\s.*$", ""), F.lit("dd/MMM/yyyy:HH:mm:ss"))
    rows = lines.filter(F.col(column).rlike(LINE))
    return rows.select(ts.alias("ts"), g(1).alias("ip"), request[0].alias("method"), F.coalesce(F.get(request, F.lit(1)), F.lit("/")).alias("path"), g(4).cast("int").alias("status"), g(7).alias("agent")).withColumn("bot_type", bot_type(F.col("agent")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files of lines, plain or gzipped."""
    return parse(spark.read.text(path).withColumnRenamed("value", "line"))


def stream(spark: SparkSession, path: str, files_per_trigger: int = 10) -> DataFrame:
    return parse(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "line"))


def daily(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("ts").alias("date"), "bot_type").agg(F.count(F.lit(1)).alias("hits"))


def errors(log: DataFrame, most: int = 100) -> DataFrame:
    return log.filter("status >= 400").groupBy("path", "status", "bot_type").agg(F.count(F.lit(1)).alias("hits"), F.max("ts").alias("last_seen")).orderBy(F.desc("hits"), "path", "status", "bot_type").limit(most)


def bot_pages(log: DataFrame, most: int = 50) -> DataFrame:
    return log.filter(~F.col("bot_type").isin("Human", "Unknown")).groupBy("path").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("bot_type").alias("bots")).orderBy(F.desc("hits"), "path").limit(most)


def figures(log: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    good = F.count_if((F.col("status") < 400) & (F.col("bot_type") == "Googlebot"))
    bots = F.count_if(F.col("bot_type") == "Googlebot")
    return log.agg(F.count_if(F.col("bot_type") == "Human").alias("human_hits"), bots.alias("googlebot_hits"), F.count_if(F.col("status") >= 400).alias("errors"), total.alias("hits"), F.when(bots > 0, F.round(good * 100.0 / bots, 4)).otherwise(0.0).alias("crawl_efficiency"))
