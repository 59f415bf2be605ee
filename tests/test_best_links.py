"""The best links to each target equal those of scoring every pair, and no row is written for each pair."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sitelode import catalog_queries
from sitelode.operators import best_links, links

PAGE = "page_key string, url string, canonical_url string, title string, h1_text string, site string, need double, authority double"
NEAR = "target_key string, source_key string, similarity double"


def frames(spark, seed: int, n: int = 60):
    rng = random.Random(seed)
    words = ["bicycle", "bells", "mountain", "the", "rental-shop", "ΟΔΟΣ", "garden", "İstanbul", "service", "of", "hire", "carriages", "wooden"]
    text = lambda a, b: "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", " - ", "  "]) for _ in range(rng.randrange(a, b)))
    pages, sentences, existing, near = [], [], [], set()
    for i in range(n):
        key = f"/{'abc'[i % 3]}/{rng.choice(['bicycle-bells', 'carriages', str(i)])}-{i if rng.random() < 0.9 else 1}"
        if any(p[0] == key for p in pages):
            continue
        canonical = rng.choice([None, None, None, "https://x.example/same"])
        title, h1 = (rng.choice([None, "", "carriages", "Wooden carriages | all", text(1, 6), text(3, 9)]) for _ in range(2))
        pages.append((key, f"https://x.example{key}", canonical, title, h1, f"s{i % 3}", rng.choice([0.0, 16.0, 70.5, 90.0]), rng.choice([6.0, 24.5, 46.0])))
        sentences += [(key, f"h{rng.randrange(10**6)}", rng.choice([None, "", text(2, 12), text(2, 12), text(4, 20)])) for _ in range(rng.randrange(0, 9))]
    keys = [p[0] for p in pages]
    existing = [(rng.choice(keys), rng.choice(keys)) for _ in range(n)]
    near = {(rng.choice(keys), rng.choice(keys)) for _ in range(3 * n)}
    near = [(a, b, rng.choice([0.58, 0.7, 0.95, float("nan")])) for a, b in sorted(near)]
    pages = spark.createDataFrame(pages, PAGE)
    targets = pages.filter("crc32(page_key) % 4 > 0").select(F.col("page_key").alias("target_key"), F.concat_ws(" ", "title", "h1_text").alias("text"))
    near = spark.createDataFrame(near, NEAR).join(targets.select("target_key"), "target_key", "left_semi")
    sentences = spark.createDataFrame(sentences, "source_key string, sentence_id string, sentence string").dropDuplicates(["source_key", "sentence_id"])
    return pages, targets, sentences, spark.createDataFrame(existing, "from_key string, to_key string"), near


def every_pair(pages, targets, sentences, existing, near, k):
    found = links.with_vectors(links.word_candidates(targets, sentences, existing), near, sentences, targets, existing)
    rows = links.anchored(links.apart(found, pages).join(pages.select(F.col("page_key").alias("target_key"), "title", "h1_text", "need"), "target_key"))
    rows = rows.join(pages.select(F.col("page_key").alias("source_key"), "site", "authority"), "source_key").filter("anchor <> ''")
    out = []
    for r in rows.select("*", links.semantic_boost(F.col("similarity")).alias("boost"), F.size(links.link_tokens(F.col("anchor"))).alias("n")).collect():
        anchor = min(12, max(4, r["n"] * 3 + (3 if len(r["anchor"]) >= 8 else 0)))
        score = int(min(100, max(0, r["need"] + r["authority"] + r["overlap"] * 8 + r["boost"] + anchor)) + 0.5)
        if score >= links.LEAST_SCORE:
            out.append((r["site"], r["target_key"], -score, r["source_key"], r["anchor"], -r["overlap"]))
    best, held = [], {}
    for r in sorted(out):
        held[r[:2]] = held.get(r[:2], 0) + 1
        if held[r[:2]] <= k:
            best.append(r)
    return best, len(out)


@pytest.mark.parametrize(("seed", "k", "block"), [(1, 3, 1000), (2, 1, 7), (3, 2, 25)])
def test_equals_scoring_every_pair(spark, monkeypatch, seed, k, block):
    monkeypatch.setattr(best_links, "TARGETS", block)
    monkeypatch.setattr(best_links, "SENTENCES", block)
    given = frames(spark, seed)
    want, all_ = every_pair(*given, k)
    got = [tuple(r) for r in best_links.best_links(*given, k, part=2 * block).select("site", "target_key", -F.col("score"), "source_key", "anchor", -F.col("overlap")).collect()]
    assert sorted(got) == want and len(want) > 50 and all_ > len(want)


def test_no_pages_and_no_near_pairs(spark):
    pages, targets, sentences, existing, near = frames(spark, 4)
    want, _ = every_pair(pages, targets, sentences, existing, near.limit(0), 3)
    assert best_links.best_links(pages, targets, sentences, existing, near.limit(0)).count() == len(want) > 0
    assert best_links.best_links(pages.limit(0), targets.limit(0), sentences.limit(0), existing.limit(0), near.limit(0)).count() == 0


def test_no_row_is_written_for_each_pair(spark, tmp_path):
    """150 pages of ten sentences: each sentence shares words with each title, so that there are 220,000 pairs."""
    ends = ["morning", "evening", "winter", "summer", "harbour", "village", "station", "market", "garden", "castle"]
    body = "".join(f"<p>Our mountain bicycle rental is open in the {e} for everybody who likes to ride around the old town and the river.</p>" for e in ends)
    pages = [(i, f"https://x.example/p/page-{i}", f"<html><head><title>Mountain bicycle tour {i}</title></head><body><main><h1>Mountain bicycle rental {i}</h1>{body}</main></body></html>") for i in range(150)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(150)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "sitelode"
    before = set(shared.glob("*"))
    chosen = catalog_queries.QUERIES["r16_recommendations"](spark, str(tmp_path))
    assert chosen.count() > 0
    assert sum(spark.read.parquet(str(p)).count() for p in set(shared.glob("*")) - before) < 20_000
