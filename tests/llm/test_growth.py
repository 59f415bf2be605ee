"""Models and messages at sizes that small tables do not reach."""

from __future__ import annotations

import pickle
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from sitelode.llm import katz, language, quality


def test_thousands_of_tags_make_a_small_model(spark):
    tag = lambda k: "q" + "".join(chr(97 + k // 26**j % 26) for j in range(3))
    count = 5_000
    texts = F.concat_ws(" ", *[F.concat(F.lit(w), F.substring(F.sha2(F.concat_ws("-", "k", "j", F.lit(w)), 256), 1, 6)) for w in ("a", "b", "c")])
    names = spark.createDataFrame([(k, tag(k)) for k in range(count)], "k int, declared string")
    rows = names.join(spark.range(4).select(F.col("id").alias("j"))).select(texts.alias("text"), "declared")
    model = language.fit_text(rows)
    assert model.languages == sorted(tag(k) for k in range(count))
    assert len(pickle.dumps(model)) < 10 << 20
    few = rows.filter(F.col("declared") < tag(0)[:3] + "c").limit(40).collect()
    scores = model.scores(language.Words.of([r["text"].encode() for r in few], lower=True))
    assert [model.languages[k] for k in scores.argmax(axis=1)] == [r["declared"] for r in few]


def test_slots_are_counted_by_language():
    raw = [b"one two one", b"", b"two", b"x one"]
    label = np.array([1, 0, 1, 0])
    keys, n = language.slot_counts(language.Words.of(raw), label)
    wanted = {}
    for text, k in zip(raw, label.tolist(), strict=True):
        words = language.Words.of([text])
        slots, owner = language.gram_slots(words)
        for w in words.ids.tolist():
            for slot in slots[owner == w].tolist():
                wanted[k << language.BITS | slot] = wanted.get(k << language.BITS | slot, 0) + 1
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == wanted


def test_only_occupied_buckets_are_met():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 100_000, np.uint64, endpoint=False))
    for buckets in (1, 7, 4_096, 1_200_000_000):
        found = katz._ranges(keys, buckets)
        assert [x for _, a, b in found for x in range(a, b)] == list(range(len(keys))) and len({i for i, _, _ in found}) == len(found)
        assert all(int(k) * buckets >> 64 == i for i, a, b in found for k in (keys[a], keys[b - 1]))
    assert katz._ranges(keys[:0], 5) == []


def test_arrays_travel_whole():
    for n in (0, 1, 4, 5, 1_000):
        for kind in ("u1", "u4", "i8", "u8", "f8"):
            x = np.arange(n).astype(kind)
            assert np.array_equal(katz.expand(katz.squeeze(x), kind), x)


def test_the_fit_holds_its_sample_once():
    rng, each = np.random.default_rng(1), 20_000
    tracemalloc.start()
    rows = [(i, i % 2, i // 2 % 4, rng.integers(0, 1 << quality.BITS, each, np.int32), np.full(each, 1 / each, np.float32)) for i in range(400)]
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.reset_peak()
    assert quality._fitted(rows).rows == 400
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.2 * held
