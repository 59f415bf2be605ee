"""Vectors as integers, in blocks of rows that tasks read one at a time.

A row is kept if its vector has ``dims`` components, none of them null, not finite, or ``LARGEST`` or more in size once
scaled: beyond that, sums of squares would not fit 64 bits. Repeated rows and ids are rows of their own. Only the id, vector
and label columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIMS = 64
LARGEST = 1 << 28
#: Vectors of a block.
ROWS = 1 << 14


def kept_vectors(df: DataFrame, scale: int, dims: int = DIMS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """_id, _label and _v, the integers floor(scale * x), of the rows that are kept."""
    scaled = lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * F.lit(float(scale)) < float(LARGEST))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    good = df.filter((F.size(vector_col) == dims) & F.forall(vector_col, fits))
    return good.select(F.col(id_col).alias("_id"), label.alias("_label"), F.transform(vector_col, lambda x: scaled(x).cast("int")).alias("_v"))


def vector_blocks(kept: DataFrame, dims: int = DIMS, orders: Callable[[np.ndarray], np.ndarray] | None = None, rows: int = ROWS) -> DataFrame:
    """Written blocks of at most ``rows`` vectors: ids, labels, points (32-bit, row by row), orders (what ``orders`` gives)."""
    id_kind, label_kind = (kept.schema[c].dataType.simpleString() for c in ("_id", "_label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - count)
                held.append(part)
                at, count = at + part.num_rows, count + part.num_rows
                if count == rows:
                    yield row(number, held)
                    number, held, count = number + 1, [], 0
        if held:
            yield row(number, held)

    def row(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        points = whole["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dims)
        listed = lambda c: pa.ListArray.from_arrays(pa.array([0, len(points)], pa.int32()), pa.concat_arrays(whole[c].chunks))
        made = orders(points) if orders else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays([pa.array([number]), listed("_id"), listed("_label"), pa.array([points.tobytes()]), pa.array([made.tobytes()])], names=["block", "ids", "labels", "points", "orders"])

    shape = f"block long, ids array<{id_kind}>, labels array<{label_kind}>, points binary, orders binary"
    return written(kept.mapInArrow(run, shape), "vectors")


def read_points(row: pa.StructScalar | dict, dims: int = DIMS) -> np.ndarray:
    return np.frombuffer(row["points"], np.int32).reshape(-1, dims).astype(np.int64)


def first_vectors(kept: DataFrame, n: int, *order) -> np.ndarray:
    """The first ``n`` vectors in an order; rows that tie in it come in the order of their components, null ids last."""
    found = kept.orderBy(*order, "_v").limit(n).select("_v").collect()  # at most n rows
    return np.array([r[0] for r in found], np.int64) if found else np.empty((0, 0), np.int64)
