"""Pages of a provider's answers as a Spark data source: a partition for each chunk of days, read page by page.

Layout: ``path/chunk=<first day>/page=<number>/``, one JSON payload ``{"rows": [...]}`` to a page. A chunk is read as a
provider is asked: from page 0 on, up to the first page that is missing or not full, at most ``most_pages``; if the last of
these is full, the chunk may go on and is marked ``cut_off``. Filters on ``chunk`` choose the partitions, so that other
chunks are neither listed nor opened. Nothing is kept between pages, so a task holds one page.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.paging import place

# Rows of a full page, and the most pages a provider is asked for.
PAGE_SIZE, MOST_PAGES = 25_000, 200
TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda day, days: day in days}


@dataclass
class Chunk(InputPartition):
    day: str


class PagedFiles(DataSource):
    """Options: ``path``, ``page_size``, ``most_pages``."""

    @classmethod
    def name(cls) -> str:
        return "paged_files"

    def schema(self) -> str:
        return "chunk date, page int, cut_off boolean, payload string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PagedReader(self.options["path"], int(self.options.get("page_size", PAGE_SIZE)), int(self.options.get("most_pages", MOST_PAGES)))


class PagedReader(DataSourceReader):
    def __init__(self, path: str, page_size: int, most_pages: int):
        self.path, self.page_size, self.most_pages = path, page_size, most_pages
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes comparisons of the chunk; what is left stays with Spark."""
        for f in filters:
            if type(f) in TESTS and f.attribute == ("chunk",) and f.value is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Chunk]:
        names = [name for name in self._folders("") if name.startswith("chunk=")]
        days = sorted(name.removeprefix("chunk=") for name in names)
        return [Chunk(day) for day in days if all(TESTS[type(f)](date.fromisoformat(day), f.value) for f in self.filters)]

    def read(self, partition: Chunk | None) -> Iterator[tuple]:
        if partition is None:  # no chunk is left
            return
        for page in range(self.most_pages):
            payload = self._payload(f"chunk={partition.day}/page={page}")
            if payload is None:
                return
            full = self._rows(payload) >= self.page_size
            yield date.fromisoformat(partition.day), page, full and page == self.most_pages - 1, payload
            if not full:
                return

    @staticmethod
    def _rows(payload: str) -> int:
        """Rows of a page; what cannot be read has none, and ends its chunk."""
        try:
            rows = json.loads(payload).get("rows")
        except (ValueError, AttributeError):
            return 0
        return len(rows) if isinstance(rows, list) else 0

    def _files(self, folder: str):  # noqa: ANN202
        from pyarrow.fs import FileSelector, FileSystem

        system, root = FileSystem.from_uri(self.path)
        return system, system.get_file_info(FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))

    def _folders(self, folder: str) -> list[str]:
        return [x.base_name for x in self._files(folder)[1]]

    def _payload(self, folder: str) -> str | None:
        system, found = self._files(folder)
        for x in sorted(found, key=lambda x: x.path):
            if x.size and not x.base_name.startswith((".", "_")):
                with system.open_input_stream(x.path) as held:
                    return held.read().decode()
        return None


def read_pages(spark: SparkSession, path: str, page_size: int = PAGE_SIZE, most_pages: int = MOST_PAGES) -> DataFrame:
    """chunk, page, cut_off, payload; ``providers.search_rows`` and its like unfold the payloads in the JVM."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedFiles)
    return spark.read.format("paged_files").options(path=path, page_size=page_size, most_pages=most_pages).load()


def land_pages(rows: DataFrame, row: Column, order: list[Column], path: str, page_size: int = PAGE_SIZE) -> None:
    """Writes the layout from ``rows`` with a column ``chunk``: ``row`` is what a payload has of each. Places in the order number
    the pages, so no chunk is sorted in one task; a group is one page."""
    placed = place(rows.withColumn("_row", row), [F.col("chunk"), *order]).places("_place").select("chunk", "_place", "_row")
    first = placed.groupBy("chunk").agg(F.min("_place").alias("_first"))
    paged = placed.join(first, "chunk").withColumn("page", F.floor((F.col("_place") - F.col("_first")) / page_size).cast("int"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_row"))), lambda x: x["_row"])
    payloads = paged.groupBy("chunk", "page").agg(F.to_json(F.struct(ordered.alias("rows"))).alias("payload"))
    payloads.write.partitionBy("chunk", "page").text(path)
