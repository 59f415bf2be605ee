"""Vector codes and centroid clusters against plain versions that compare everything."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelode.llm import centroids, codes, queries

from .fixtures import clashing

SHAPE = "vec_id long, embedding array<float>, label int"


def rows(seed: int = 1, n: int = 300) -> list[tuple]:
    """With copies, ties on a coarse grid, equal and null ids, null labels, and rows that are not kept."""
    rng = np.random.default_rng(seed)
    grid = lambda: [float(x) for x in rng.integers(-3, 4, 64) / 256]
    fine = lambda: [float(np.float32(x)) for x in rng.normal(size=64) / 8]
    hot = fine()
    out = [(i, [grid, fine, lambda: hot][i % 3](), [None, 1, 2, 2][i % 4]) for i in range(n)]
    out += [(5, hot, 1), (5, grid(), 1), (None, grid(), None), (None, hot, 3)]
    nan, inf = float("nan"), float("inf")
    return out + [(7, None, 1), (8, [], 1), (9, [0.5] * 63, 1), (10, [0.5] * 65, 1), (11, [nan] + [0.0] * 63, 1), (12, [0.0] * 63 + [-inf], 1), (13, [None] + [0.0] * 63, 1), (14, [1e30] + [0.0] * 63, 1)]


def kept(found: list[tuple], scale: int) -> list[tuple]:
    good = [r for r in found if r[1] is not None and len(r[1]) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 1e20 for x in r[1])]
    return [(i, np.array([math.floor(scale * x) for x in v]), label) for i, v, label in good]


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    return apart.argmin(axis=1), apart.min(axis=1)


def lloyd(points: np.ndarray, entries: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        of, _ = nearest(points, entries)
        entries = np.array([[int(s) // int((of == k).sum()) for s in points[of == k].sum(axis=0)] if (of == k).any() else e for k, e in enumerate(entries)])
    return entries


def coded(found: list[tuple]) -> list[tuple]:
    data = sorted(kept(found, 256), key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    points, books, number, error = np.array([r[1] for r in data]), [], [], 0
    for part in np.split(points, 16, axis=1):
        books.append(lloyd(part, part[:64], 2))
        of, apart = nearest(part, books[-1])
        number.append(of)
        error = error + apart
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = {}
    for r, e in zip(data, error, strict=True):
        total[r[2]] = total.get(r[2], 0) + int(e)
    return sorted(((r[0], "".join(f"{n[i]:02x}" for n in number), int(error[i]), total[r[2]], digest) for i, r in enumerate(data)), key=repr)


def clustered(found: list[tuple]) -> list[tuple]:
    data = kept(found, 64)
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist())
    data.sort(key=key)
    points = np.array([r[1] for r in data])
    at = lloyd(points, points[:16], 3)
    of, apart = nearest(points, at)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((r[0], int(c), int(d), int(apart[of == c].sum()), int(apart.sum()), digest[c]) for r, c, d in zip(data, of, apart, strict=True)), key=repr)


@pytest.fixture
def tables(spark, tmp_path):
    def make(found: list[tuple]) -> str:
        clashing(spark.createDataFrame(found, SHAPE)).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
        return str(tmp_path)

    return make


@pytest.mark.parametrize("n", [300, 40, 3])
def test_codes_match_brute_force(spark, tables, n):
    got = queries.op12_vector_codes(spark, tables(rows(n=n)))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == coded(rows(n=n))


@pytest.mark.parametrize("n", [300, 6])
def test_clusters_match_brute_force(spark, tables, n):
    got = queries.op13_centroid_clusters(spark, tables(rows(n=n)))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == clustered(rows(n=n))


def test_many_blocks_give_what_one_gives(spark):
    df = spark.createDataFrame(rows(2), SHAPE).repartition(5)
    for run, more in ((codes.compress, "codes"), (centroids.clusters, "cluster")):
        (one, first), (many, second) = run(df), run(df, rows=17)
        assert (first == second).all()
        assert sorted(map(repr, one.select("vec_id", more).collect())) == sorted(map(repr, many.select("vec_id", more).collect()))


@pytest.mark.parametrize("kind", ["empty", "none kept"])
def test_no_vectors(spark, tables, kind):
    at = tables([] if kind == "empty" else [(1, None, 1), (2, [float("nan")] * 64, None)])
    assert queries.op12_vector_codes(spark, at).count() == 0 and queries.op13_centroid_clusters(spark, at).count() == 0


@pytest.mark.parametrize(("n", "size"), [(1, 9), (16, 3), (17, 3), (1000, 2), (3000, 100)])
def test_tree_assigns_as_measuring_does(n, size):
    rng = np.random.default_rng(n)
    points, entries = rng.integers(-size, size, (n, 4)), rng.integers(-size, size, (64, 4))
    tree = codes.Tree(points, codes.tree_order(points))
    found = codes.Assigned(tree, entries, each=True)
    of, _ = nearest(points, entries)
    assert (found.by_row() == of).all()
    assert (found.counts == np.bincount(of, minlength=64)).all()
    assert all((found.sums[k] == points[of == k].sum(axis=0)).all() for k in range(64))


def test_boxes_spare_measuring():
    """Tight groups go to their entries as whole subtrees."""
    rng = np.random.default_rng(5)
    middle = rng.integers(-1000, 1000, (64, 4))
    points = np.repeat(middle, 100, axis=0) + rng.integers(-2, 3, (6400, 4))
    found = codes.Assigned(codes.Tree(points, codes.tree_order(points)), middle)
    assert found.counts.sum() == 6400 and found.measured < 640


def test_search_gives_up_early():
    rng = np.random.default_rng(6)
    at = rng.integers(-500, 500, (16, 64))
    points = at[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, 64))
    search = centroids.Search(points, at)
    of, apart = nearest(points, at)
    assert (search.cluster == of).all() and (search.distance == apart).all()
    assert search.taken < search.whole / 4


def test_search_with_ties():
    points = np.tile(np.arange(64), (5, 1))
    at = np.stack([points[0] + 1, points[0] - 1, points[0] + 1, points[0] + 2])
    search = centroids.Search(points, at)
    assert search.cluster.tolist() == [0] * 5 and search.distance.tolist() == [64] * 5
    assert centroids.Search(points, at[::-1]).cluster.tolist() == [1] * 5


def test_kept_vectors_are_stated(spark):
    df = spark.createDataFrame(rows(), SHAPE)
    assert codes.compress(df)[0].agg(F.count("*")).first()[0] == len(kept(rows(), 256))
