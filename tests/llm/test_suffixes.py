"""Repeated passages: the parts of the merge sort, and the operator against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelode.llm import queries, suffixes

from .fixtures import DOCS, clashing, documents, prose


def removed(rows: list[tuple], length: int) -> list[tuple]:
    """(id, bytes, spans, what stays) of (id, text), string by string."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - length + 1):
                w = t[p : p + length]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - length + 1 if i is not None else 0):
            if least[t[p : p + length]] < i:
                gone[p + 1 : p + length + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        out.append((i, len(t), list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(t, gone[1:-1], strict=True) if not g)))
    return sorted(out, key=repr)


def got(df) -> list[tuple]:
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in df.collect()), key=repr)


def hostile() -> list[tuple]:
    """Runs of one byte, zero bytes, periods, a hot line with many neighbours, copies, bits of passages, equal ids."""
    line, base = "the same line of every page ends here. ", prose(3, 200)
    rows = [(1, "a" * 300), (2, "a" * 49), (3, "a" * 50 + "b"), (4, "ab" * 100), (5, "x" + "ba" * 60), (6, "\0" * 80), (7, "y\0" * 70 + "\0" * 60)]
    rows += [(10, base), (11, base), (11, base), (12, base[5:400] + prose(4, 30) + base[300:420]), (9, base[100:149] + "Z" + base[100:150]), (13, base[:50]), (14, base[:49])]
    rows += [(None, base), (15, None), (16, ""), (None, None), (8, base[700:]), (17, "é" * 30 + base[:60] + "é" * 30), (18, "é" * 30 + "ö" + base[10:80])]
    return rows + [(100 + i % 37, prose(50 + i, 6) + " " + line * (1 + i % 3) + prose(90 + i, 6)) for i in range(60)]


@pytest.mark.parametrize(("length", "block", "run"), [(50, 1 << 24, 1 << 18), (50, 700, 60), (33, 2000, 100)])
def test_matches_brute_force(spark, monkeypatch, length, block, run):
    monkeypatch.setattr(suffixes, "RUN", run)
    monkeypatch.setattr(suffixes, "SLICE", 500)
    rows = [(i, t) for i, t in hostile()]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(3)
    result = suffixes.repeated_passages(clashing(docs), length, block=block, bucket=300, per_range=400)
    assert got(result) == removed(rows, length)


def test_query_matches_brute_force(spark, sf):
    want = sorted((i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in removed([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], 50))
    out = queries.op11_suffix_dedup(spark, sf)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r) for r in out.collect()) == want
    assert sum(r[2] for r in want) > 0


def test_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffixes.repeated_passages(empty).count() == 0
    docs = documents(spark)
    assert got(suffixes.repeated_passages(clashing(docs))) == removed([tuple(r) for r in docs.select("doc_id", "text").collect()], 50)
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert all(not s for _, _, s, _ in got(suffixes.repeated_passages(nameless)))


def strings(seed: int, n: int, letters: int) -> list[bytes]:
    rng = np.random.default_rng(seed)
    return [bytes(rng.integers(0, letters, size, dtype=np.uint8)) for size in rng.integers(50, 77, n)]


def as_words(texts: list[bytes]) -> np.ndarray:
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + bytes(104), np.uint8)
    return suffixes.read_words(data, np.cumsum(sizes) - sizes, sizes, suffixes.words_of(50))


@pytest.mark.parametrize(("letters", "runs"), [(2, 1), (2, 7), (256, 64), (1, 3), (3, 200)])
def test_merge_equals_sorting(letters, runs):
    """With front coding on the way; the lengths that the trees report are those shared with the string before."""
    parts = [sorted({t.ljust(79, b"\0") + bytes([len(t)]) for t in strings(k, 40 + k % 5, letters)}) for k in range(runs)]
    words, common = [], []
    for part in parts:
        made = suffixes.front_code(as_words([p[: p[79]] for p in part]))
        words.append(suffixes.front_decode(made[0].astype(np.int64), made[1], made[2], 10))
        common.append(made[0].astype(np.int64))
        assert words[-1].astype(">u8").tobytes() == b"".join(part)
    starts = np.append(0, np.cumsum([len(p) for p in parts]))
    flat = [t for p in parts for t in p]
    order, met = suffixes.merge_runs(np.concatenate(words), np.concatenate(common), starts)
    merged = [flat[i] for i in order]
    assert sorted(order.tolist()) == list(range(len(flat))) and merged == sorted(flat)
    for a, b, m in zip(merged, merged[1:], met[1:], strict=False):
        same = next((i for i in range(80) if a[i] != b[i]), 80)
        assert m == same or m == 0  # 0 at the beginning of a sub-range
        assert (m == 80) == (a == b)
