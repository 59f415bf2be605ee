"""Compression of vectors to one byte for each of 16 parts, with codebooks fitted by filtering Lloyd rounds.

Vectors are integers and cut into equal consecutive parts. For each part every block of rows has a kd-tree over its points,
built once and stored as an order of the points, from which boxes, sums and counts of all nodes follow by adding up pairs.
A round walks the tree from the root with the entries that may still be nearest: the entry nearest to the middle of a node's
box is compared with each other one at the corner of the box that favours the other most, and who loses even there is
nearest to no point of the box. A node with one entry left goes to it as a whole, by its stored sum and count; only in
leaves with several entries left are points measured. The tests are on integers and exact, ties going to the lower number.
All nodes of a level are worked on at once.

Blocks send sums and counts of each entry, which are added up on both sides of the shuffle; the driver holds the codebooks
only, whose size the parameters fix. Blocks stay where they are, and a block's size is fixed, so no label, vector or group
of copies is hot. The sum over a label joins back to the rows by a join that deals both sides, which adaptive execution can
split.

Which rows are kept is said in ``vectors``. Entries begin as the kept rows with the smallest ids, null ids last, equal ids in
the order of their components; with fewer rows there are fewer entries. Null labels count as one label. An empty table gives
no rows.
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

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Most points of a leaf.
LEAF = 16


def depth_of(n: int) -> int:
    depth = 0
    while n > LEAF << depth:
        depth += 1
    return depth


def cuts(n: int, depth: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end: every node is halved."""
    edges = np.array([0, n], np.int64)
    for _ in range(depth):
        edges = np.insert(edges, np.arange(1, len(edges)), (edges[:-1] + edges[1:]) // 2)
    return edges


def tree_order(points: np.ndarray) -> np.ndarray:
    """The order of points in the leaves: each level sorts every node along the widest side of its box."""
    order = np.arange(len(points))
    for depth in range(depth_of(len(points))):
        edges = cuts(len(points), depth)
        inside = points[order]
        wide = np.maximum.reduceat(inside, edges[:-1]) - np.minimum.reduceat(inside, edges[:-1])
        node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        along = inside[np.arange(len(order)), wide.argmax(axis=1)[node]]
        order = order[np.lexsort((along, node))]
    return order


class Tree:
    """Boxes, sums and counts of all nodes, level by level; level 0 is the root."""

    def __init__(self, points: np.ndarray, order: np.ndarray):
        self.points, self.order, depth = points[order], order, depth_of(len(points))
        edges = cuts(len(points), depth)
        level = [f.reduceat(self.points, edges[:-1]) for f in (np.minimum, np.maximum, np.add)]
        self.edges, self.levels = [edges], [(*level, np.diff(edges))]
        for _ in range(depth):
            low, high, total, count = self.levels[0]
            self.levels.insert(0, (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), total[::2] + total[1::2], count[::2] + count[1::2]))
            self.edges.insert(0, self.edges[0][::2])


class Assigned:
    """The nearest entry of every point of a tree: sums and counts by entry, and the entry of each point if wanted."""

    def __init__(self, tree: Tree, entries: np.ndarray, each: bool = False):
        self.tree, self.entries = tree, entries
        self.sums, self.counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
        self.of = np.zeros(len(tree.points), np.int64) if each else None
        #: Points that were measured one by one.
        self.measured = 0
        nodes, may = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        for depth, level in enumerate(tree.levels):
            may = self._filtered(may, level[0][nodes], level[1][nodes])
            whole = may.sum(axis=1) == 1
            self._assign(depth, nodes[whole], may[whole].argmax(axis=1))
            nodes, may = nodes[~whole], may[~whole]
            if depth < len(tree.levels) - 1:
                nodes, may = (2 * nodes[:, None] + [0, 1]).ravel(), np.repeat(may, 2, axis=0)
        self._measure(nodes, may)

    def _filtered(self, may: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        middle = ((2 * self.entries[None] - (low + high)[:, None]) ** 2).sum(axis=2)
        best = np.where(may, middle, np.iinfo(np.int64).max).argmin(axis=1)
        mine, others = self.entries[best][:, None], self.entries[None]
        corner = np.where(others > mine, high[:, None], low[:, None])
        lead = ((others - mine) * (others + mine - 2 * corner)).sum(axis=2)  # how much farther the other one is there
        number = np.arange(len(self.entries))[None]
        out = (lead > 0) | ((lead == 0) & (number > best[:, None]))
        return may & ~out

    def _assign(self, depth: int, nodes: np.ndarray, entry: np.ndarray) -> None:
        _, _, total, count = self.tree.levels[depth]
        np.add.at(self.sums, entry, total[nodes])
        np.add.at(self.counts, entry, count[nodes])
        if self.of is not None:
            at, _ = self._points(self.tree.edges[depth], nodes)
            self.of[at] = np.repeat(entry, count[nodes])

    def _points(self, edges: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = edges[nodes + 1] - edges[nodes]
        which = np.repeat(np.arange(len(nodes)), count)
        return np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + edges[nodes][which], which

    def _measure(self, nodes: np.ndarray, may: np.ndarray) -> None:
        at, which = self._points(self.tree.edges[-1], nodes)
        points = self.tree.points[at]
        apart = ((points[:, None] - self.entries[None]) ** 2).sum(axis=2)
        entry = np.where(may[which], apart, np.iinfo(np.int64).max).argmin(axis=1)
        np.add.at(self.sums, entry, points)
        self.counts += np.bincount(entry, minlength=len(self.entries))
        self.measured = len(points)
        if self.of is not None:
            self.of[at] = entry

    def by_row(self) -> np.ndarray:
        out = np.empty_like(self.of)
        out[self.tree.order] = self.of
        return out


def trees(row: dict, dims: int, parts: int) -> list[Tree]:
    points = read_points(row, dims)
    orders = np.frombuffer(row["orders"], np.int32).reshape(parts, -1)
    return [Tree(p, order) for p, order in zip(np.split(points, parts, axis=1), orders, strict=True)]


def codebooks(blocks: DataFrame, start: np.ndarray, parts: int, rounds: int, dims: int) -> np.ndarray:
    """(part, entry, component) after the rounds."""
    books = np.stack(np.split(start, parts, axis=1))
    width = dims // parts
    sums = [f"s{i} long" for i in range(width)]

    for _ in range(rounds):
        now = books

        def run(batches: Iterator[pa.RecordBatch], books: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found = [Assigned(tree, entries) for tree, entries in zip(trees(row, dims, parts), books, strict=True)]
                    total, count = np.concatenate([x.sums for x in found]), np.concatenate([x.counts for x in found])
                    place = np.indices(books.shape[:2]).reshape(2, -1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*place, count, *total.T)], names=["part", "entry", "n", *(s.split()[0] for s in sums)])

        partial = blocks.select("points", "orders").mapInArrow(run, ", ".join(["part int, entry int, n long", *sums]))
        added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s.split()[0]).alias(s.split()[0]) for s in sums])
        books = now.copy()
        for r in added.filter("n > 0").collect():  # one row for each entry
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return books


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rows: int = ROWS) -> tuple[DataFrame, np.ndarray]:
    """(one row per kept row: id, label, codes, error and label_error; the codebooks, by part, entry and component)."""
    if dims % parts or entries > 256:
        raise ValueError("parts must divide dims, and entries must fit a byte")
    kept = kept_vectors(df, scale, dims, id_col, vector_col, label_col)
    id_kind, label_kind = (kept.schema[c].dataType.simpleString() for c in ("_id", "_label"))

    def orders(points: np.ndarray) -> np.ndarray:
        return np.stack([tree_order(p) for p in np.split(points, parts, axis=1)]).astype(np.int32)

    blocks = vector_blocks(kept, dims, orders, rows)
    start = first_vectors(kept, entries, F.col("_id").asc_nulls_last())
    books = codebooks(blocks, start, parts, rounds, dims) if len(start) else np.empty((parts, 0, dims // parts), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("points", "orders")}
                found = [Assigned(tree, b, each=True).by_row() for tree, b in zip(trees(row, dims, parts), books, strict=True)]
                code = np.stack(found, axis=1).astype(np.uint8)
                near = np.concatenate([b[c] for b, c in zip(books, found, strict=True)], axis=1)
                error = ((read_points(row, dims) - near) ** 2).sum(axis=1)
                flat = pa.array([bytes(x) for x in code], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, flat, pa.array(error)], names=["_id", "_label", "codes", "error"])

    coded = written(blocks.mapInArrow(run, f"_id {id_kind}, _label {label_kind}, codes binary, error long"), "codes")
    sums = written(coded.groupBy("_label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("_label", "_of")
    joined = coded.join(sums, F.col("_label").eqNullSafe(F.col("_of")))
    return joined.select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), "codes", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
