"""Clusters of vectors by Lloyd rounds with partial-distance search.

A block keeps its vectors with the components of highest variance in all rows first. The search for the nearest centroid
adds up integer squared differences over the first STEP components for all centroids; the whole distance of the one that
leads there is the first bound. Every other centroid goes on from its sum, STEP components at a time, and is given up for a
vector once the sum is strictly above the best so far. Who survives all components is compared on the whole distance, ties
going to the smaller number. So the result is that of comparing everything, and most centroids cost a few components only.

Blocks send sums and counts of each cluster, which are added up on both sides of the shuffle; the driver holds the centroids
only, whose number is a parameter. Blocks stay where they are and have a fixed size, so neither a large cluster nor a group
of copies is hot.

Which rows are kept is said in ``vectors``. Centroids begin as the kept rows with the smallest SHA-256 of seed and id; rows
without id come last, equal ids in the order of their components; with fewer rows there are fewer centroids. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import DIMS, ROWS, first_vectors, kept_vectors, read_points, vector_blocks

CLUSTERS, ROUNDS, SCALE, SEED = 16, 3, 64, "1"
#: Components that are added up between two looks at the bound.
STEP = 8


class Search:
    """Nearest centroids of points whose components are in falling order of variance."""

    def __init__(self, points: np.ndarray, centroids: np.ndarray):
        head = np.stack([((points[:, :STEP] - c[:STEP]) ** 2).sum(axis=1) for c in centroids])
        led = head.argmin(axis=0)
        self.distance = ((points - centroids[led]) ** 2).sum(axis=1)
        self.cluster = led.copy()
        #: Squared differences taken, of those that comparing everything takes.
        self.taken, self.whole = head.size * min(STEP, points.shape[1]) + points.size, points.size * len(centroids)
        for number, centroid in enumerate(centroids):
            alive = np.flatnonzero((led != number) & (head[number] <= self.distance))
            so_far = head[number, alive]
            for at in range(STEP, points.shape[1], STEP):
                some = points[alive, at : at + STEP] - centroid[at : at + STEP]
                self.taken += some.size
                so_far = so_far + (some * some).sum(axis=1)
                stays = so_far <= self.distance[alive]
                alive, so_far = alive[stays], so_far[stays]
            nearer = (so_far < self.distance[alive]) | (self.cluster[alive] > number)
            self.cluster[alive[nearer]], self.distance[alive[nearer]] = number, so_far[nearer]


def variance_order(kept: DataFrame, dims: int) -> np.ndarray:
    """The components by falling variance over all rows, and by number; any order gives the same clusters."""
    each = kept.select(*[F.var_pop(F.col("_v")[i]).alias(f"v{i}") for i in range(dims)]).first()  # one row
    return np.argsort(-np.array([x or 0.0 for x in each]), kind="stable")


def clusters(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED, dims: int = DIMS, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = ROWS) -> tuple[DataFrame, np.ndarray]:
    """(one row per kept row: id, cluster, distance, cluster_inertia and inertia; the centroids)."""
    kept = kept_vectors(df, scale, dims, id_col, vector_col)
    spark, id_kind = df.sparkSession, kept.schema["_id"].dataType.simpleString()
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    centroids = first_vectors(kept, k, key.asc_nulls_last())
    if not len(centroids):
        shape = f"{id_col} {id_kind}, cluster int, distance long, cluster_inertia long, inertia long"
        return spark.createDataFrame([], shape), centroids
    order = variance_order(kept, dims)
    blocks = vector_blocks(kept, dims, rows=rows)
    first, names = centroids[:, order], [f"s{i}" for i in range(dims)]

    last = first
    for _ in range(rounds):
        now = last

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    points = read_points(row, dims)[:, order]
                    cluster = Search(points, now).cluster
                    sums = np.zeros_like(now)
                    np.add.at(sums, cluster, points)
                    arrays = [np.arange(len(sums), dtype=np.int32), np.bincount(cluster, minlength=len(sums)), *sums.T]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["cluster", "n", *names])

        partial = blocks.select("points").mapInArrow(run, ", ".join(["cluster int, n long", *(f"{n} long" for n in names)]))
        added = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names])
        last = now.copy()
        for r in added.filter("n > 0").collect():  # one row for each cluster
            last[r["cluster"]] = [r[n] // r["n"] for n in names]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                search = Search(read_points({"points": batch.column("points")[i].as_py()}, dims)[:, order], last)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(search.cluster.astype(np.int32)), pa.array(search.distance)], names=["_id", "cluster", "distance"])

    assigned = written(blocks.mapInArrow(assign, f"_id {id_kind}, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row for each cluster
    of_cluster = F.array(*[F.lit(sums.get(i, 0)).cast("long") for i in range(len(last))])[F.col("cluster")]
    centroids = np.empty_like(last)
    centroids[:, order] = last
    out = assigned.select(F.col("_id").alias(id_col), "cluster", "distance", of_cluster.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"))
    return out, centroids


def digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
