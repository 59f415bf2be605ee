"""One way in for daily provider rows: validated, staged, made current at once, and what follows from them derived anew.

A run writes its valid rows by day under a folder of its own, with the page facts of those days and the monthly sums of
their months, and only then a new version of the manifest, which names for every dataset and partition the run that is
current. Readers go by the latest complete manifest. So a run that fails anywhere before leaves the old days current, and
a run that is repeated replaces its days. Rows received, accepted and rejected are counted in the pass that stages them.
The ledger has one row for each run that became current.

Partitions are whole: a run brings all rows of a day that it has. One run at a time may write to a folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import rollup_pages, valid_row
from ..plans.search_report import monthly_summary

#: Datasets and the column that each is partitioned by.
DATASETS = {"search": "date", "pages": "date", "months": "month_start"}
MANIFEST = "dataset string, part date, run string"
LEDGER = "run string, received long, accepted long, rejected long, days long, version long"


class Warehouse:
    """Datasets ``search`` (date, page_key, query and measures), ``pages`` and ``months`` under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def ingest(self, rows: DataFrame, keys: int, named: Callable[[DataFrame], DataFrame], run: str | None = None) -> dict[str, int]:
        """``rows``: keys (array), clicks, impressions, ctr, position. ``named`` gives the columns date, page_key and query
        of valid rows. Returns the counts."""
        run = run or uuid.uuid4().hex
        counts = self._stage(rows, keys, named, run)
        days = self._parts("search", run)
        if days:
            self._derive_pages(run)
            self._derive_months(run, days)
        counts["days"] = len(days)
        self._make_current(run, counts)
        return counts

    def read(self, dataset: str) -> DataFrame:
        """What is current: the partitions that the manifest names, each from its run."""
        return self._read(dataset, [(r["run"], r["part"]) for r in self._manifest().filter(F.col("dataset") == dataset).collect()])

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger")

    # -- stages of a run

    def _stage(self, rows: DataFrame, keys: int, named: Callable[[DataFrame], DataFrame], run: str) -> dict[str, int]:
        seen = Observation(f"rows-{run}")
        counts = F.count(F.lit(1)).alias("received"), F.count_if("_ok").alias("accepted")
        judged = rows.withColumn("_ok", valid_row(keys))
        valid = named(judged.observe(seen, *counts).filter("_ok")).select("date", "page_key", "query", "clicks", "impressions", "position")
        self._write(valid, "search", run)
        # Where nothing is valid, the optimiser may leave nothing to observe.
        found = seen.get if self._parts("search", run) else judged.agg(*counts).first().asDict()
        return {"received": found["received"], "accepted": found["accepted"], "rejected": found["received"] - found["accepted"]}

    def _derive_pages(self, run: str) -> None:
        self._write(rollup_pages(self._read("search", [(run, d) for d in self._parts("search", run)])), "pages", run)

    def _derive_months(self, run: str, days: list[date]) -> None:
        """Whole months: the run's days, and the current ones of the same months that it does not replace."""
        months = {d.replace(day=1) for d in days}
        kept = [(r["run"], r["part"]) for r in self._manifest().filter("dataset = 'search'").collect() if r["part"].replace(day=1) in months and r["part"] not in set(days)]
        self._write(monthly_summary(self._read("search", [*kept, *((run, d) for d in days)])), "months", run)

    def _make_current(self, run: str, counts: dict[str, int]) -> None:
        """The manifest's next version: what the run brought, beside what it did not replace."""
        brought = [(name, part, run) for name in DATASETS for part in self._parts(name, run)]
        new = self.spark.createDataFrame(brought, MANIFEST)
        old = self._manifest().join(new.select("dataset", "part"), ["dataset", "part"], "left_anti").select(new.columns)
        version = self._version() + 1
        # A reader takes the highest version that has its mark of success, which Spark writes last.
        old.unionByName(new).coalesce(1).write.parquet(f"{self.root}/manifest/{version:012d}")
        row = [(run, counts["received"], counts["accepted"], counts["rejected"], counts["days"], version)]
        self.spark.createDataFrame(row, LEDGER).coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    # -- files

    def _write(self, df: DataFrame, dataset: str, run: str) -> None:
        by = DATASETS[dataset]
        df.repartition(F.col(by)).write.mode("overwrite").partitionBy(by).parquet(f"{self.root}/{dataset}/run={run}")

    def _read(self, dataset: str, parts: list[tuple[str, date]]) -> DataFrame:
        """Only the files of the named partitions; the columns of the dataset."""
        by = DATASETS[dataset]
        shape = _SHAPES[dataset]
        if not parts:
            return self.spark.createDataFrame([], shape)
        paths = [f"{self.root}/{dataset}/run={run}/{by}={part}" for run, part in parts]
        found = self.spark.read.schema(f"{shape}, run string").option("basePath", f"{self.root}/{dataset}").parquet(*paths)
        return found.drop("run")

    def _parts(self, dataset: str, run: str) -> list[date]:
        """The partitions that a run has written."""
        return sorted(date.fromisoformat(name.split("=")[1]) for name in self._names(f"{self.root}/{dataset}/run={run}") if "=" in name)

    def _names(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []

    def _version(self) -> int:
        done = [v for v in self._names(f"{self.root}/manifest") if "_SUCCESS" in self._names(f"{self.root}/manifest/{v}")]
        return max(map(int, done), default=0)

    def _manifest(self) -> DataFrame:
        version = self._version()
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{version:012d}")


_SUMS = "clicks long, impressions long"
_SHAPES = {
    "search": f"page_key string, query string, {_SUMS}, position double, date date",
    "pages": f"page_key string, {_SUMS}, position double, query_count long, date date",
    "months": f"page_key string, query string, {_SUMS}, position_sum double, month_start date",
}
