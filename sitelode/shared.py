"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master (tests) may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/sitelode-shared"
    return root


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes and reads back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/sitelode/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, names: dict[str, str]) -> Iterator[None]:
    """What is written inside is written under these settings; the session gets its own back."""
    before = {n: spark.conf.get(n, None) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


@contextmanager
def small_parts(spark: SparkSession, tasks: int) -> Iterator[None]:
    """What is written inside reads splits of 8 MB and shuffles to ``tasks`` partitions or more, merged up to 16 MB: a task
    that aggregates rows of which few are equal holds all of its part, whose size then stays the same for any table."""
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = {"spark.sql.shuffle.partitions": str(max(now, tasks)), "spark.sql.files.maxPartitionBytes": "8m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
    with settings(spark, names):
        yield
