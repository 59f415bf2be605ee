"""Hot keys, odd tables and the registered queries."""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitelode.llm import chat, katz, language, media, packing, piece_model, quality, queries, shards
from sitelode.llm.words import Words, segment_sums

from .fixtures import DOCS, clashing, documents, rows


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- words ----------------------------------------------------------------------------------------------------------------


def test_words_are_numbered_by_content():
    raw = [b"a bb a\tccc\n", b"", b"  ", ("x" * 40 + " é " + "x" * 40 + " " + "x" * 41).encode(), b"bb"]
    words = Words.of(raw)
    split = [w for x in raw for w in x.split()]
    assert words.counts.tolist() == [len(x.split()) for x in raw]
    assert words.as_list(words.ids) == split and words.size == len(set(split))
    alone = {w: int(Words.of([w]).hashes[0]) for w in set(split)}
    assert [int(h) for h in words.hashes[words.ids]] == [alone[w] for w in split]
    data, starts, lengths = words.joined
    assert [bytes(data[a : a + n]) for a, n in zip(starts, lengths, strict=True)] == words.as_list(np.arange(words.size))


def test_sums_of_a_run_depend_on_the_run_alone():
    values = np.random.default_rng(1).normal(size=1000)
    alone = segment_sums(values[300:500], np.array([200]))[0]
    assert segment_sums(values, np.array([300, 200, 0, 500]))[1] == alone


# -- language model -------------------------------------------------------------------------------------------------------


def test_stored_model_scores_as_the_operator_does(spark, docs):
    """Recursive evaluation over the plain rows of the stored tables."""
    scores, paths = katz.katz(clashing(docs), F.col("doc_id") > 2, order=2)
    got = {(r["doc_id"], round(r["score"], 6)) for r in scores.collect()}
    counts = {(r["order"], r["key"]): r["count"] for r in katz.model_counts(spark, paths).collect()}
    weights = {(r["order"], r["key"]): r["weight"] for r in katz.model_weights(spark, paths).collect()}
    of = Counter((k, c) for (k, _), c in counts.items())
    n = sum(c for (k, _), c in counts.items() if k == 1)
    cut = {k: katz.discounts([of[k, r] for r in range(1, katz.MOST + 2)]) for k in (1, 2)}
    p = lambda k, r, c: cut[k][min(r, katz.MOST + 1)] * r / (c + katz.SPARE)
    unknown = (sum((1 - cut[1][r]) * r * of[1, r] for r in range(1, katz.MOST + 1)) + katz.SPARE) / (n + katz.SPARE)
    trained = sum((r[0] or 0) > 2 for r in rows())
    assert not spark.catalog.listTables("default") or not any(t.name.startswith("sitelode_blocks") for t in spark.catalog.listTables("default"))
    wanted = set()
    for i, text, *_ in rows():
        ones, twos = katz.ngram_keys(text, 2)
        total = 0.0
        for j in range(len(ones)):
            context = trained if j == 0 else counts.get((1, int(ones[j - 1])), 0)
            start = int((katz.START ^ katz._turn(2)).astype(np.uint64).view(np.int64)) if j == 0 else int(ones[j - 1])
            if (2, int(twos[j])) in counts:
                total += math.log10(p(2, counts[2, int(twos[j])], context))
            else:
                total += weights.get((2, start), 0.0) if context else 0.0
                total += math.log10(p(1, counts[1, int(ones[j])], n) if (1, int(ones[j])) in counts else unknown)
        wanted.add((i, round(total, 6)))
    assert {(i, round(s, 5)) for i, s in got} == {(i, round(s, 5)) for i, s in wanted}


# -- quality --------------------------------------------------------------------------------------------------------------


def test_quality_verdict_follows_from_the_weights_under_any_partitioning(spark, docs):
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    model = quality.fit(quality.labelled_features(docs, labels))
    assert model is not None
    found = []
    for n in (1, 7):
        got = quality.score(clashing(docs).repartition(n), model).collect()
        found.append(sorted(((r["doc_id"], r["n_words"], r["probability"].hex(), r["kept"]) for r in got), key=str))
    assert found[0] == found[1]
    texts = {i: t for i, t, *_ in rows()}
    for i, _, p, kept in found[0]:
        if i is None or i == 2:
            continue
        words = Words.of([(texts[i] or "").encode()])
        slots, values = quality.Features.of(words).sparse()[0]
        margin = model.bias + sum(float(model.weights[s]) * v for s, v in zip(slots.tolist(), values.tolist(), strict=True))
        own = 1 / (1 + math.exp(-max(-40, min(40, model.slope * margin + model.offset))))
        assert own == pytest.approx(float.fromhex(p), abs=1e-6)
        failed = bool(quality.base_failed(quality.counts(words))[0])
        assert kept == (not failed and own >= quality.KEEP_AT)
    kept = quality.keep_good(clashing(docs), model)
    assert kept.columns == clashing(docs).columns and {r["kept"] for r in kept.select("kept").collect()} <= {"kept"}


def test_quality_and_language_of_an_empty_table(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(empty, labels).isEmpty() and quality.keep_good(empty, None).isEmpty()
    found = language.identify(language.document_evidence(clashing(empty)), ["doc_id"])
    assert found.isEmpty()


def test_fit_finds_the_words_that_decide():
    good, bad = [f"calm river stone {i}" for i in range(40)], [f"buy now cheap {i}" for i in range(40)]
    sparse = quality.Features.of(Words.of([x.encode() for x in good + bad])).sparse()
    made = quality._fitted([(i, int(i < 40), i % 4, s.astype(np.int32), v.astype(np.float32)) for i, (s, v) in enumerate(sparse)])
    p = made.probability(quality.Features.of(Words.of([b"calm river stone 99", b"buy now cheap 99"])))
    assert p[0] > 0.8 and p[1] < 0.2


# -- shards ---------------------------------------------------------------------------------------------------------------


def test_shards_of_hot_rows_and_of_many_small_sources(spark):
    hot = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("a").alias("source"))
    null = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit("b").alias("source"))
    small = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    found = shards.interleave(clashing(hot.unionByName(null).unionByName(small)), shards=8)
    per = {r["shard"]: r for r in found.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"), F.count_if(F.expr("source = 'a'")).alias("a"), F.count_if(F.expr("source = 'b'")).alias("b"), F.count_if(F.expr("startswith(source, 's')")).alias("s")).collect()}
    assert len(per) == 8 and {r["n"] for r in per.values()} == {5000} and {r["slots"] for r in per.values()} == {5000} and {r["last"] for r in per.values()} == {4999}
    assert all(abs(r["a"] - 3750) < 80 and abs(r["b"] - 625) < 80 and abs(r["s"] - 625) < 80 for r in per.values())
    steps = found.groupBy(F.floor(F.col("fraction") * 100)).count().agg(F.max("count")).first()[0]
    assert steps < 600


# -- media ----------------------------------------------------------------------------------------------------------------


def fragmented() -> bytes:
    """Two tracks without samples of their own; a fragment for each, and one more run of the first."""
    stbl = lambda codec: media.box(b"stbl", media.full(b"stsd", 0, 0, struct.pack(">I", 1), media.box(codec, bytes(8))), media.full(b"stts", 0, 0, bytes(4)), media.full(b"stsc", 0, 0, bytes(4)), media.full(b"stsz", 0, 0, bytes(8)), media.full(b"stco", 0, 0, bytes(4)))
    trak = lambda n, codec: media.box(b"trak", media.full(b"tkhd", 0, 7, struct.pack(">III", 0, 0, n), bytes(68)), media.box(b"mdia", media.full(b"mdhd", 0, 0, struct.pack(">IIII", 0, 0, 1000, 0), bytes(4)), media.box(b"minf", stbl(codec))))
    mvex = media.box(b"mvex", media.full(b"trex", 0, 0, struct.pack(">5I", 1, 1, 40, 3, media.NOT_SYNC)), media.full(b"trex", 0, 0, struct.pack(">5I", 2, 1, 20, 2, 0)))
    out = media.box(b"moov", trak(1, b"avc1"), trak(2, b"mp4a"), mvex)
    run = media.full(b"trun", 0, 0x1 | 0x4 | 0x200, struct.pack(">IiI", 3, 0, 0), struct.pack(">3I", 5, 6, 7))
    size = len(media.box(b"moof", media.box(b"traf", media.full(b"tfhd", 0, 0x20000, struct.pack(">I", 1)), run), media.box(b"traf", media.full(b"tfhd", 0, 0x20000, struct.pack(">I", 2)), media.full(b"trun", 0, 0x1, struct.pack(">Ii", 4, 0)))))
    run = media.full(b"trun", 0, 0x1 | 0x4 | 0x200, struct.pack(">IiI", 3, size + 8, 0), struct.pack(">3I", 5, 6, 7))
    moof = media.box(b"moof", media.box(b"traf", media.full(b"tfhd", 0, 0x20000, struct.pack(">I", 1)), run), media.box(b"traf", media.full(b"tfhd", 0, 0x20000, struct.pack(">I", 2)), media.full(b"trun", 0, 0x1, struct.pack(">Ii", 4, size + 8 + 18))))
    out += moof + media.box(b"mdat", b"aaaaabbbbbbccccccc" + b"11223344")
    at = len(out)
    last = media.box(b"moof", media.box(b"traf", media.full(b"tfhd", 0, 0x1, struct.pack(">IQ", 1, at)), media.full(b"trun", 0, 0x1 | 0x100, struct.pack(">Ii", 2, 0), struct.pack(">2I", 1, 2))))
    last = media.box(b"moof", media.box(b"traf", media.full(b"tfhd", 0, 0x1, struct.pack(">IQ", 1, at)), media.full(b"trun", 0, 0x1 | 0x100, struct.pack(">Ii", 2, len(last) + 8), struct.pack(">2I", 1, 2))))
    return out + last + media.box(b"mdat", b"dddeee")


def test_fragments_and_all_tracks(spark):
    file = fragmented()
    one, two = media.probe(file)
    cut = lambda t: [file[a : a + n] for a, n in zip(t["offsets"].tolist(), t["sizes"].tolist(), strict=True)]
    assert cut(one) == [b"aaaaa", b"bbbbbb", b"ccccccc", b"ddd", b"eee"] and one["keys"].tolist() == [0] and one["duration"] == 3 * 40 + 3
    assert cut(two) == [b"11", b"22", b"33", b"44"] and two["keys"].tolist() == [0, 1, 2, 3] and two["duration"] == 80
    df = spark.createDataFrame([(1, file), (1, file), (2, file[:-3]), (3, None)], "id int, data binary")
    got = media.probe_media(clashing(df), "id", "data").collect()
    assert [r["n_samples"] for r in got if r["id"] == 1] == [5, 5] and [t["codec"] for t in got[0]["tracks"]] == ["avc1", "mp4a"]
    assert all(r["error"] and r["tracks"] is None for r in got if r["id"] > 1)
    assert media.probe_media(df.limit(0), "id", "data").isEmpty()


def test_media_and_pieces_of_an_empty_table(empty):
    assert media.text_media(clashing(empty)).isEmpty() and piece_model.encode(clashing(empty)).isEmpty() and packing.pack(clashing(empty)).isEmpty()


# -- chats ----------------------------------------------------------------------------------------------------------------


def test_a_conversation_of_equal_rows_is_cut(spark):
    n = 20_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text"))
    found = chat.format_chats(clashing(turns))
    assert sorted(r[0] for r in found.select("seq").collect()) == list(range(n))
    whole = "".join(r["rendered"] for r in found.orderBy("seq").collect())
    assert whole == "".join(r["rendered"] for r in chat.repair(["user"] * n, ["hi"] * n))


# -- queries and the pipeline ---------------------------------------------------------------------------------------------


def test_queries_give_the_columns_of_their_contracts(spark, sf):
    found = {k: f(spark, sf) for k, f in queries.QUERIES.items() if k in ("op1_katz_backoff", "op3_quality_rules", "op6_bounded_packing", "op8_near_duplicates")}
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    scored = {r["doc_id"]: r for r in found["op1_katz_backoff"].collect()}
    assert {i: r["held_out"] for i, r in scored.items()} == {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    lower = {i: [*t.encode().lower().split(), None] for i, t in docs.items()}
    train = Counter(w for i, ws in lower.items() if not scored[i]["held_out"] for w in ws)
    total = sum(train.values())
    for i, r in scored.items():
        base = sum(math.log10((train[w] + 1) / (total + len(train) + 1)) for w in lower[i])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(lower[i]), sum(train[w] > 0 for w in lower[i]), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    kept = {r["doc_id"]: r for r in found["op3_quality_rules"].collect()}
    assert all(not (r["base_failed"] and r["kept"]) and r["base_failed"] >= (r["n_words"] < 50) for r in kept.values()) and set(kept) == set(docs)
    groups = found["op8_near_duplicates"].collect()
    assert {r["doc_id"] for r in groups} == set(docs) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in groups)
    pieces = found["op6_bounded_packing"].collect()
    ends = Counter()
    for r in pieces:
        ends[r["doc_id"]] += r["length"]
    assert all(ends[r["doc_id"]] == r["doc_tokens"] for r in pieces) and set(ends) == set(docs)


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_on_odd_tables(spark, docs, tmp_path, kind):
    table = clashing(docs) if kind == "odd" else clashing(docs).limit(0)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    if kind == "empty":
        assert found == []
        return
    ids = {r["doc_id"] for r in found}
    assert ids and not ids & {3, 4, 5, 7, 8, 9, 10}
    assert all(sum(r["length"] for r in found if r["doc_id"] == i) == next(r["doc_tokens"] for r in found if r["doc_id"] == i) for i in ids)
