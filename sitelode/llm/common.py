"""Helpers that the data-preparation operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local master (tests) may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/sitelode-shared"
    return found


#: Paths handed out to this process's sessions, so that a caller who has written his result can remove what led to it.
_HANDED_OUT: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sitelode/{name}-{uuid.uuid4().hex}"
    _HANDED_OUT.append(path)
    return path


def mark() -> int:
    return len(_HANDED_OUT)


def release(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Removes the intermediate tables made after ``since``. Only once nothing lazy reads them any more."""
    gone = [p for p in _HANDED_OUT[since:] if p not in keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _HANDED_OUT.remove(path)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no earlier stage."""
    path = path or shared_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
