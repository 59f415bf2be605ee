"""Texts and tables made to break an operator."""

from __future__ import annotations

import re
import time

import pytest

import corpus_pipeline
from sitelode.llm import quality, secrets

from .fixtures import DOCS, prose, rows

MEGABYTE = 1 << 20
KEY = "-----BEGIN RSA PRIVATE KEY-----"
TEXTS = {
    "pem": "-----BEGIN " + "AB " * (MEGABYTE // 3),
    "webtoken": "eyJ" * (MEGABYTE // 3),
    "webtoken with dots": "eyJ." + "eyJ" * 100 + "." + "eyJ" * (MEGABYTE // 3),
    "assign": "token" + " " * MEGABYTE,
    "assign again": "token " * (MEGABYTE // 6),
    "access": "AKIA" * (MEGABYTE // 4),
    "bearer": "sk_" * (MEGABYTE // 3),
}


@pytest.mark.parametrize("kind", TEXTS)
def test_a_megabyte_of_beginnings_is_scanned_in_seconds(spark, kind):
    docs = spark.createDataFrame([(1, TEXTS[kind] + f" {KEY} ", None, None, 1)], DOCS)
    began = time.monotonic()
    found, _ = secrets.scan_versions(docs)
    spans = found.first()["findings"]
    assert [s["kind"] for s in spans][-1] == "pem" and spans[-1]["end"] - spans[-1]["start"] == len(KEY)
    assert time.monotonic() - began < 40


def test_pipeline_with_hostile_texts(spark, tmp_path):
    """Behind prose that passes the quality rules, so that they reach the secret stage."""
    head = " ".join(r[1] for r in rows() if r[0] and r[0] >= 100)
    bad = [(1000 + i, f"{head} {prose(400 + i, 300)} {t[:300_000]}", "en", "a", 1) for i, t in enumerate(TEXTS.values())]
    spark.createDataFrame([*rows(), *bad], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_fit_takes_one_row_of_a_labelled_id_and_a_bound_of_bytes(spark):
    docs = spark.createDataFrame([*rows(), *[(100, prose(7, 60), "en", "a", 1)] * 20_000], DOCS)
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(20)] + [(2, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.labelled_features(docs, labels).select("_id", "_label").collect()
    assert sorted(r["_id"] for r in found) == [2, *range(100, 120)]
    few = quality.labelled_features(docs, labels, most_bytes=3000).count()
    assert 0 < few < 10


LONG = {
    "webtoken": ["eyJ" + "a" * 3000 + ".b.c", "-eyJ.x eyJa eyJeyJb.eyJc.d.e zeyJq." + "y" * 30 + ".z_.eyJr.s.t" + "0" * 20, "eyJ" + "a-" * 300 + "eyJ." + "b" * 600 + "..eyJ" + "c" * 30 + ".d.e"],
    "pem": ["-----BEGIN " + "AB " * 300 + "PRIVATE KEY-----", "-----BEGIN PRIVATE KEY----------BEGIN EC PRIVATE PRIVATE KEY-----"],
}


@pytest.mark.parametrize("kind", LONG)
def test_no_bound_on_what_a_rule_matches(spark, kind):
    """As Python's matcher finds them; a header has more than 512, a label more than 64 characters."""
    rule = next(r for r in secrets.RULES if r.kind == kind)
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(LONG[kind])], DOCS)
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["findings"] if s["kind"] == kind] for r in secrets.scan_versions(docs)[0].collect()}
    plain = {"webtoken": r"eyJ[\w-]+\.[\w-]+\.[\w-]+", "pem": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"}[kind]
    assert found == {i: [m.span() for m in re.finditer(plain, t) if len(m[0]) >= rule.least] for i, t in enumerate(LONG[kind])}
    assert all(found.values())
