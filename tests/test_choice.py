"""Choosing links by components, word candidates by light and heavy words."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelode import catalog_queries
from sitelode.functions.text import STOP_WORDS
from sitelode.operators import choice, links, words_met
from sitelode.operators.components import component_of

SHAPE = "site string, source_key string, target_key string, anchor string, score int"


def one_by_one(rows: list[tuple]) -> set[tuple]:
    count, out = Counter(), set()
    for r in sorted(rows, key=lambda r: (-r[4], r[2], r[1], r[3].lower(), r[3])):
        site, source, target, anchor, _ = r
        text = anchor.lower()
        keys = [((site, "s", source), 3), ((site, "t", target), 5), ((site, "ta", target, text), 2), ((site, "sa", source, text), 1), ((site, "st", source, target), 1)]
        if all(count[k] < cap for k, cap in keys):
            count.update(k for k, _ in keys)
            out.add(r)
    return out


def candidates(seed: int, n: int, pages: int) -> list[tuple]:
    rng = random.Random(seed)
    return list({(f"site{rng.randrange(2)}", f"/p{rng.randrange(pages)}", f"/q{rng.randrange(pages)}", rng.choice(["Red shoes", "red shoes", "blue hats", "green socks"]), rng.randrange(40)) for _ in range(n)})


@pytest.mark.parametrize(("rounds", "block"), [(0, 50_000), (1, 60), (30, 1)])
def test_equals_taking_one_at_a_time(spark, rounds, block):
    rows = candidates(3, 250, 25)
    got = {tuple(r) for r in choice.choose(spark.createDataFrame(rows, SHAPE), None, rounds, block).collect()}
    assert got == one_by_one(rows)


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    """Each candidate hangs on the one before it: both want the same text on one page, or to one page."""
    n, rows = 10_000, []
    for i in range(n):
        rows.append(("s", f"/a{i // 2}", f"/b{(i + 1) // 2}", "one text", n - i))
    # one use of a text on a page, and two to a page: with two rows more to each target the second cap binds as well
    rows += [("s", f"/c{i}", f"/b{i}", "one text", 2 * n) for i in range(n // 2)]
    calls = []
    kept = choice._by_component
    monkeypatch.setattr(choice, "_by_component", lambda now, block: calls.append(1) or kept(now, block))
    got = {tuple(r) for r in choice.choose(spark.createDataFrame(rows, SHAPE), None, rounds=1).collect()}
    assert got == one_by_one(rows) and len(calls) <= 1


def test_the_first_of_each_site(spark):
    rows = candidates(4, 200, 30)
    got = [tuple(r) for r in choice.choose(spark.createDataFrame(rows, SHAPE), 10).collect()]
    assert Counter(r[0] for r in got) == {"site0": 10, "site1": 10}
    assert set(got) <= one_by_one(rows)
    assert choice.choose(spark.createDataFrame([], SHAPE)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(100, 400)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2000), (1, 2), (2, 1), (1, 2)]
    random.Random(1).shuffle(pairs)
    got = {r["node"]: r["root"] for r in component_of(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = {i: 100 for i in range(100, 401)} | {1000 + i: 1000 for i in range(50)} | {2000: 2000, 1: 1, 2: 1}
    assert got == want


# -- words ----------------------------------------------------------------------------------------------------------------


def tables(spark, seed: int):
    rng = random.Random(seed)
    rare, common = [f"rare{i}" for i in range(300)], [f"common{i}" for i in range(12)]
    words = lambda n: " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n))
    targets = [(f"/t{i}", words(rng.randrange(0, 7))) for i in range(60)] + [("/none", None), ("/stop", "the and")]
    sentences = [(f"/{rng.choice('ts')}{i % 60}", f"h{i}", words(rng.randrange(0, 14))) for i in range(400)] + [("/s1", "x", None), ("/s2", "long", " ".join(rare + common))]
    existing = [(f"/s{i}", f"/t{i}") for i in range(0, 60, 7)]
    return targets, sentences, existing, tuple(spark.createDataFrame(*x) for x in ((targets, "target_key string, text string"), (sentences, "source_key string, sentence_id string, sentence string"), (existing, "from_key string, to_key string")))


@pytest.mark.parametrize(("least", "light"), [(2, 8), (2, 0), (1, 8), (3, 40)])
def test_word_candidates_match_brute_force(spark, least, light):
    targets, sentences, existing, frames = tables(spark, least * 10 + light)
    own = lambda text: {w for w in (text or "").split() if w not in STOP_WORDS}
    want = {(t, s, i, len(own(a) & own(b))) for t, a in targets for s, i, b in sentences if s != t and (s, t) not in set(existing) and len(own(a) & own(b)) >= least}
    got = [tuple(r) for r in words_met.word_candidates(*frames, least, light).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_words_that_all_have_bring_few_together(spark):
    """Pairs that meet stay within three times the candidates, though a few words stand in every second sentence."""
    _, _, _, (targets, sentences, _) = tables(spark, 1)
    met = words_met.meetings(targets, sentences)
    n = sum(m.count() for m in met)
    kept = sum(m.filter(F.col("first") & (F.col("overlap") >= 2)).count() for m in met)
    assert kept > 1000 and n <= 3 * kept


def test_a_pair_meets_once_however_many_words_it_shares(spark):
    text = " ".join(f"common{i}" for i in range(40))
    targets = spark.createDataFrame([(f"/t{i}", text) for i in range(5)], "target_key string, text string")
    sentences = spark.createDataFrame([(f"/s{i}", "h", text) for i in range(20)], "source_key string, sentence_id string, sentence string")
    assert sum(m.count() for m in words_met.meetings(targets, sentences)) == 100


def test_registered_word_candidates_are_those_of_the_asking_pages(spark):
    sf = "/root/testdata/sf0.01"
    known, *frames = catalog_queries._linkable(spark, sf)
    asking = {r["page_key"] for r in known.filter("page_id % 100 = 0").collect()}
    want = sorted(tuple(r) for r in words_met.word_candidates(*frames).collect() if r["target_key"] in asking)
    assert want and sorted(tuple(r) for r in catalog_queries.QUERIES["j19_word_candidates"](spark, sf).collect()) == want


def test_anchors_are_found_by_many_tasks(spark):
    """Candidates take few bytes each, so that adaptive execution puts all of them into one partition."""
    rows = spark.range(2000).selectExpr("concat('a red bicycle bell here ', id) sentence", "'/bicycle-bell' target_key", "'Bicycle bell' title", "'' h1_text")
    found = links.anchored(rows.groupBy("target_key", "title", "h1_text", "sentence").count())
    shown = found.withColumn("task", F.spark_partition_id()).collect()
    assert {r["anchor"] for r in shown} == {"bicycle bell"} and len({r["task"] for r in shown}) > 1


def test_estimate_of_a_run(spark):
    rows = [("a", f"p{i % 3}", "x" * 100, 0.0, 0.0) for i in range(9)] + [("a", "p9", "x" * 100, 0.4, 0.0), ("a", "p9", "x", None, 0.65), ("b", "q", "x" * 10, None, None), ("b", "q", None, 0.35, 0.64)]
    sentences = spark.createDataFrame(rows, "site string, page_key string, sentence string, link_density double, boilerplate double")
    found = {r["site"]: r for r in links.estimate(sentences, ["site"], max_pages=2, max_sentences=3, most_links=5000, embedding="Voyage:v-3", review="ollama").collect()}
    a, b = found["a"], found["b"]
    assert (a["pages"], a["sentences"], a["embedding_tokens"], a["review_tokens"]) == (2, 6, 150, 450_000)
    assert abs(a["total_cost"] - 150 / 1e6 * 0.12) < 1e-15 and a["review_cost"] == 0
    assert (b["pages"], b["sentences"], b["embedding_tokens"]) == (1, 2, 24)
    assert links.estimate(sentences.limit(0), ["site"]).collect() == []
    assert [links.price(x, links.REVIEW_PRICES) for x in ("", "local", "openrouter:gemini", "other:anthropic-x", "openai")] == [0, 0, 0.15, 0.8, 0.2]
