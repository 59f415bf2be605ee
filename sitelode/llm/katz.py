"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

For a token w after the context h of order k (its last k - 1 tokens), with r = count(h w) and C = count(h) in training:

    p_k(w | h) = discount_k(r) * r / (C + SPARE)          if r > 0
               = alpha_k(h) * p_{k-1}(w | shorter h)      if r = 0 and C > 0
               = p_{k-1}(w | shorter h)                   if C = 0

and at the bottom p_1 is discounted likewise, what it leaves going to one class of unknown words. SPARE counts are set
aside in every context, so that a context whose followers are all frequent (and therefore undiscounted) still leaves
something to back off with. alpha_k(h) = (1 - sum of p_k over seen followers) / (1 - sum of p_{k-1} over the same), so all
probabilities after any context add up to one.

How it runs. Words are 64-bit hashes. Documents are read once into blocks of about BLOCK tokens, a table bucketed by
block. A block asks for what it lacks, and buckets of the hash space answer:

1. each block sends its distinct n-grams with their training counts, once each; a bucket adds them up, stores its part of
   the counts (the table ``kind=model``), and answers each block with the totals and with which n-grams that block owns
   (it is the first to hold them);
2. each block sends, per context, the sums over the followers it owns, and the contexts it needs a weight for; a bucket
   adds up, stores alpha, and answers;
3. each block evaluates its tokens, from the highest order down, and emits its documents' scores.

N-grams are told apart by 64-bit hashes: of N distinct ones about N^2 / 2^65 pairs clash and share a count. At 3 TB, 10^12
n-grams, that is some 30,000 pairs.

A frequent word or n-gram is one entry per block, so no key is hot; buckets are ranges of a hash, so they are even. What
a task holds is a block or a bucket; a block is cut between documents, so a text of more than BLOCK words makes a block of
its own size. Blocks never move: the table's bucketing serves steps 2 and 3. Messages travel as compressed byte planes; the
model is stored as arrays of numbers (``model_counts``, ``model_weights``).

Null or empty texts are a lone end token; rows with repeated or null ids are scored each on their own; an empty table
gives no rows; without training rows every token is unknown, with probability one. Only the id and text columns and what
``train`` names are read, so other columns may have any names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parallelism, shared_path
from .words import Words, as_bytes, distinct, mix, segment_sums, slices

ORDER = 2
BLOCK = 2_000_000
#: N-grams that a bucket is meant to answer for.
BUCKET = 500_000
#: Bytes of an array that are not worth a compressed frame.
PLAIN = 32
#: Counts up to this are discounted.
MOST = 5
SPARE = 0.5
END, START = np.uint64(0x656E64), np.uint64(0x7374617274)


def _turn(k: int) -> np.uint64:
    """A constant of its own for each order."""
    return np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))


# -- arrays in rows -------------------------------------------------------------------------------------------------------


def squeeze(x: np.ndarray) -> bytes:
    """An array as zstd-compressed planes of its bytes: high bytes, mostly zero, shrink to nothing. Few bytes, which a frame
    would not shorten, are taken as they are; the first byte tells which."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return b"\0" + planes if len(planes) <= PLAIN else b"\1" + zstandard.compress(planes, 1)


def expand(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data[1:]) if data[0] else data[1:], np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_keys(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data, "u8"), dtype=np.uint64)


# -- blocks ---------------------------------------------------------------------------------------------------------------


@dataclass
class Block:
    """``tokens`` are word hashes; each document's end with END. ``sizes`` has the tokens of each document."""

    number: int
    tokens: np.ndarray
    sizes: np.ndarray
    train: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Positions at which a document begins."""
        return np.cumsum(self.sizes) - self.sizes

    def orders(self, order: int) -> list[Grams]:
        """The n-grams that end at each token, for n from 1 to ``order``."""
        found, begins = [], np.zeros(len(self.tokens), bool)
        begins[self.first] = True
        keys, context = self.tokens, np.zeros(len(self.tokens), np.uint64)
        for k in range(1, order + 1):
            if k > 1:
                context = np.empty(len(keys), np.uint64)
                context[1:] = keys[:-1]
                context[begins] = START ^ _turn(k)
                keys = mix((context * np.uint64(2 * k + 1)) ^ mix(self.tokens + _turn(k)))
            found.append(Grams(k, context, begins, *distinct(keys)))
        return found


@dataclass
class Grams:
    order: int
    context: np.ndarray  # key of the context before each token
    begins: np.ndarray
    keys: np.ndarray  # sorted, distinct
    place: np.ndarray  # of each token's n-gram among the keys
    sample: np.ndarray  # a position of each key


def tokenised(docs: DataFrame, train: Column, id_col: str, text_col: str, block: int) -> DataFrame:
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(train, F.lit(False)).alias("_train"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for part in slices(batch, 2):
                words = Words.of(as_bytes(part.column(2)), lower=True)
                sizes = words.counts + 1
                tokens = np.full(int(sizes.sum()), END)
                last = np.zeros(len(tokens), bool)
                last[np.cumsum(sizes) - 1] = True
                if len(words.ids):
                    tokens[~last] = words.hashes[words.ids]
                held.append((part.column(0), part.column(1), tokens, sizes))
                count += len(tokens)
                if count >= block:
                    yield row(number, held)
                    number, held, count = number + 1, [], 0
        if held:
            yield row(number, held)

    def row(number: int, held: list) -> pa.RecordBatch:
        vocab, place, _ = distinct(np.concatenate([x[2] for x in held]))
        often = np.argsort(-np.bincount(place), kind="stable")  # small numbers for frequent words
        rank = np.empty(len(often), np.uint32)
        rank[often] = np.arange(len(often))
        ids = pa.chunked_array([x[0] for x in held]).combine_chunks()
        train = pa.chunked_array([x[1] for x in held]).combine_chunks()
        n = len(ids)
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x)
        arrays = [pa.array([number], pa.int64()), whole(ids), whole(train), pa.array([squeeze(np.concatenate([x[3] for x in held]))]), pa.array([squeeze(rank[place])]), pa.array([vocab[often].tobytes()]), pa.array([len(place)])]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "ids", "train", "sizes", "tokens", "vocab", "n_tokens"])

    return slim.mapInArrow(run, f"block long, ids array<{kind}>, train array<boolean>, sizes binary, tokens binary, vocab binary, n_tokens long")


def read_block(row: dict) -> Block:
    vocab = np.frombuffer(row["vocab"], np.uint64)
    return Block(row["block"], vocab[expand(row["tokens"], "u4")], expand(row["sizes"], "i8"), np.array(row["train"], bool))


# -- asking and answering -------------------------------------------------------------------------------------------------

ASKED = "order int, bucket int, block long, keys binary, n binary, mass binary, lower binary, need binary"
ANSWERED = "bucket int, block long, n binary, own binary, stats array<long>, model_keys array<long>, model_counts array<long>, kind string, order int"
WEIGHTS = "bucket int, block long, weights binary, model_keys array<long>, model_weights array<double>, kind string, order int"


def _batch(shape: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in shape.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in fields], names=[n for n, _ in fields])


def _ranges(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each bucket that has some of the sorted keys. Buckets are equal ranges of the hash space: that
    of a key is key * buckets / 2^64. Work and result go by the keys, not by the buckets."""
    if not len(keys):
        return []
    half, many = np.uint64(32), np.uint64(buckets)
    own = ((keys >> half) * many + ((keys & np.uint64(0xFFFFFFFF)) * many >> half)) >> half
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    return list(zip(own[begin].tolist(), begin.tolist(), np.append(begin[1:], len(keys)).tolist(), strict=True))


def ask_counts(blocks: DataFrame, order: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = read_block(row)
                weight = np.repeat(block.train, block.sizes).astype(np.float64)
                for grams in block.orders(order):
                    n = np.bincount(grams.place, weight, len(grams.keys)).astype(np.uint32)
                    yield _batch(ASKED, [{"order": grams.order, "bucket": i, "block": block.number, "keys": squeeze_keys(grams.keys[a:b]), "n": squeeze(n[a:b])} for i, a, b in _ranges(grams.keys, buckets)])

    return blocks.select("block", "train", "sizes", "tokens", "vocab").mapInArrow(run, ASKED)


def answer_counts(asked: pa.Table) -> pa.Table:
    """Totals of one bucket: its part of the model, and an answer to each block."""
    asked = asked.sort_by("block")
    keys = [expand_keys(x) for x in asked["keys"].to_pylist()]
    n = [expand(x, "u4") for x in asked["n"].to_pylist()]
    known, place, _ = distinct(np.concatenate(keys))
    total = np.zeros(len(known), np.int64)
    np.add.at(total, place, np.concatenate(n).astype(np.int64))
    first = np.full(len(known), len(place))
    np.minimum.at(first, place, np.arange(len(place)))
    own = np.zeros(len(place), bool)
    own[first] = True
    order, bucket, rows, at = asked["order"][0].as_py(), asked["bucket"][0].as_py(), [], 0
    for block, k in zip(asked["block"].to_pylist(), keys, strict=True):
        mine = slice(at, at + len(k))
        at += len(k)
        rows.append({"order": order, "bucket": bucket, "block": block, "n": squeeze(total[place[mine]]), "own": squeeze(np.packbits(own[mine])), "kind": "answer"})
    seen = total > 0
    stats = [int(seen.sum()), int(total.sum()), *np.bincount(np.minimum(total, MOST + 2), minlength=MOST + 3)[1 : MOST + 2].tolist()]
    rows.append({"order": order, "bucket": bucket, "model_keys": known[seen].view(np.int64), "model_counts": total[seen], "stats": stats, "kind": "model"})
    return pa.Table.from_batches([_batch(ANSWERED, rows)])


def answer_weights(asked: pa.Table) -> pa.Table:
    """log10 alpha of one bucket's contexts: its part of the model, and an answer to each block that needs some."""
    asked = asked.sort_by("block")
    keys = [expand_keys(x) for x in asked["keys"].to_pylist()]
    known, place, _ = distinct(np.concatenate(keys))
    mass, lower = np.zeros(len(known)), np.zeros(len(known))
    np.add.at(mass, place, np.concatenate([expand(x, "f8") for x in asked["mass"].to_pylist()]))
    np.add.at(lower, place, np.concatenate([expand(x, "f8") for x in asked["lower"].to_pylist()]))
    weight = np.log10(np.maximum(1 - mass, 1e-300)) - np.log10(np.maximum(1 - lower, 1e-300))
    order, bucket, rows, at = asked["order"][0].as_py(), asked["bucket"][0].as_py(), [], 0
    for block, k, need in zip(asked["block"].to_pylist(), keys, asked["need"].to_pylist(), strict=True):
        wanted = np.unpackbits(expand(need, "u1"), count=len(k)).astype(bool)
        if wanted.any():
            rows.append({"order": order, "bucket": bucket, "block": block, "weights": squeeze(weight[place[at : at + len(k)][wanted]]), "kind": "answer"})
        at += len(k)
    rows.append({"order": order, "bucket": bucket, "model_keys": known.view(np.int64), "model_weights": weight, "kind": "model"})
    return pa.Table.from_batches([_batch(WEIGHTS, rows)])


# -- evaluation -----------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """What every task knows: totals and discounts of each order."""

    tokens: int
    words: int
    documents: int
    discounts: list[np.ndarray]  # by order; entry r is that of a count r, the last of all larger ones
    unknown: float = 1.0  # what the unigrams leave: discounted counts, and the spare ones

    def probability(self, order: int, count: np.ndarray, context: np.ndarray | int) -> np.ndarray:
        """Of seen n-grams."""
        return self.discounts[order - 1][np.minimum(count, MOST + 1)] * count / (context + SPARE)


def discounts(stats: list[int]) -> np.ndarray:
    """Katz's discounts from the numbers of n-grams seen 1 to MOST + 1 times; half a count where these are too few."""
    n = np.array([0, *stats], np.float64)
    out = np.ones(MOST + 2)
    cut = (MOST + 1) * n[MOST + 1] / n[1] if n[1] else 1.0
    for r in range(1, MOST + 1):
        d = ((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    out[0] = 0.0
    return out


class Reading:
    """A block with the counts it was answered."""

    def __init__(self, block: Block, answers: list[dict], model: Model, order: int):
        self.block, self.model = block, model
        self.grams = block.orders(order)
        self.count, self.own = [], []
        for grams in self.grams:
            mine = sorted((x for x in answers if x["order"] == grams.order and x["n"] is not None), key=lambda x: x["bucket"])
            counts = [expand(x["n"], "i8") for x in mine]
            count = np.concatenate(counts) if counts else np.empty(0, np.int64)
            if len(count) != len(grams.keys):
                raise ValueError(f"block {block.number}: {len(count)} answers to {len(grams.keys)} n-grams")
            self.count.append(count)
            self.own.append(np.concatenate([np.unpackbits(expand(x["own"], "u1"), count=len(c)) for x, c in zip(mine, counts, strict=True)]).astype(bool))

    def context_count(self, order: int) -> np.ndarray:
        """Training count of the context before each token."""
        grams, below = self.grams[order - 1], self.grams[order - 2]
        out = np.empty(len(grams.context), np.int64)
        out[1:] = self.count[order - 2][below.place[:-1]]
        out[grams.begins] = self.model.documents
        return out

    def seen(self, order: int) -> np.ndarray:
        """p_order of each token whose n-gram is known; 0 elsewhere."""
        count = self.count[order - 1][self.grams[order - 1].place]
        return self.model.probability(order, count, self.model.tokens if order == 1 else self.context_count(order))

    def needed(self, order: int, found: np.ndarray) -> np.ndarray:
        """Tokens that back off from a known context of this order; ``found``: those known at a higher order."""
        unseen = self.count[order - 1][self.grams[order - 1].place] == 0
        return unseen & ~found & (self.context_count(order) > 0)

    def sums(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, sum of p_order, sum of p_{order-1}) over the followers that this block owns."""
        grams = self.grams[order - 1]
        at = grams.sample[self.own[order - 1] & (self.count[order - 1] > 0)]
        high, low = self.seen(order)[at], self.seen(order - 1)[at]
        contexts, place, _ = distinct(grams.context[at])
        return contexts, np.bincount(place, high, len(contexts)), np.bincount(place, low, len(contexts))


def ask_weights(reading: Reading, buckets: int) -> list[dict]:
    rows, found = [], np.zeros(len(reading.block.tokens), bool)
    for order in range(len(reading.grams), 1, -1):
        need = np.unique(reading.grams[order - 1].context[reading.needed(order, found)])
        found |= reading.count[order - 1][reading.grams[order - 1].place] > 0
        contexts, mass, lower = reading.sums(order)
        keys = np.union1d(contexts, need)
        put = lambda values: np.bincount(np.searchsorted(keys, contexts), values, len(keys))  # noqa: B023, E731
        mass, lower, wanted = put(mass), put(lower), np.isin(keys, need, assume_unique=True)
        for i, a, b in _ranges(keys, buckets):
            rows.append({"order": order, "bucket": i, "block": reading.block.number, "keys": squeeze_keys(keys[a:b]), "mass": squeeze(mass[a:b]), "lower": squeeze(lower[a:b]), "need": squeeze(np.packbits(wanted[a:b]))})
    return rows


def evaluate(reading: Reading, answers: list[dict]) -> dict[str, np.ndarray]:
    """Per document: tokens, known tokens, base score and log10 probability."""
    model, block = reading.model, reading.block
    score, found = np.zeros(len(block.tokens)), np.zeros(len(block.tokens), bool)
    for order in range(len(reading.grams), 1, -1):
        grams = reading.grams[order - 1]
        needed = reading.needed(order, found)
        need = np.unique(grams.context[needed])
        mine = sorted((x for x in answers if x["order"] == order and x["weights"] is not None), key=lambda x: x["bucket"])
        weights = np.concatenate([np.empty(0), *(expand(x["weights"], "f8") for x in mine)])
        if len(weights) != len(need):
            raise ValueError(f"block {block.number}: {len(weights)} weights for {len(need)} contexts")
        score[needed] += weights[np.searchsorted(need, grams.context[needed])]
        here = ~found & (reading.count[order - 1][grams.place] > 0)
        score[here] += np.log10(reading.seen(order)[here])
        found |= here
    count = reading.count[0][reading.grams[0].place]
    bottom = np.where(count > 0, reading.seen(1), model.unknown)
    score[~found] += np.log10(bottom[~found])
    base = np.log10((count + 1) / (model.tokens + model.words + 1))
    return {"n_tokens": block.sizes, "n_known": segment_sums((count > 0).astype(np.int64), block.sizes), "base_score": segment_sums(base, block.sizes), "score": segment_sums(score, block.sizes)}


# -- the operator ---------------------------------------------------------------------------------------------------------


def katz(docs: DataFrame, train: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, dict[str, str]]:
    """(scores of all rows under the model of the rows where ``train`` holds, paths of the model's tables).

    Scores: id, train, n_tokens, n_known, train_tokens, base_score, score. Tables: ``counts`` and ``weights``, partitioned
    by kind and order; ``model_counts`` and ``model_weights`` read the model from them as plain rows."""
    spark = docs.sparkSession
    wide = parallelism(spark)
    paths = {x: shared_path(spark, x) for x in ("blocks", "counts", "weights")}
    name = f"sitelode_blocks_{uuid.uuid4().hex}"
    made = tokenised(docs, train, id_col, text_col, block)
    try:
        made.write.bucketBy(wide, "block").option("path", paths["blocks"]).option("compression", "none").saveAsTable(name)
        return _scores(spark.table(name), made.schema["ids"].dataType.elementType.simpleString(), paths, order, wide, id_col), paths
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its name only: the files are in the shared folder, and the plan has them


def _scores(blocks: DataFrame, id_type: str, paths: dict[str, str], order: int, wide: int, id_col: str) -> DataFrame:
    spark = blocks.sparkSession
    # As many buckets as the tokens ask for; a block sends a bucket nothing where it has nothing, so there are never more
    # messages than n-grams.
    buckets = max(wide, math.ceil((blocks.agg(F.sum("n_tokens")).first()[0] or 0) / BUCKET))

    counts = ask_counts(blocks, order, buckets).groupBy("order", "bucket").applyInArrow(answer_counts, ANSWERED)
    counts.write.partitionBy("kind", "order").parquet(paths["counts"])
    stored = spark.read.schema(ANSWERED).parquet(paths["counts"])
    # one row for each order
    totals = {r["order"]: r for r in stored.filter("kind = 'model'").groupBy("order").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(MOST + 3)]).collect()}
    trained = blocks.select(F.explode("train").alias("t")).filter("t").count()
    model = _model(totals, trained, order)

    columns = ["block", "train", "sizes", "tokens", "vocab"]
    first = stored.filter("kind = 'answer'").select("block", "order", "bucket", "n", "own", F.lit(None).cast("binary").alias("weights"))

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_batch(ASKED, [])])
        reading = Reading(read_block(left.to_pylist()[0]), right.to_pylist(), model, order)
        return pa.Table.from_batches([_batch(ASKED, ask_weights(reading, buckets))])

    asked = blocks.select(*columns).groupBy("block").cogroup(first.groupBy("block")).applyInArrow(ask, ASKED)
    asked.groupBy("order", "bucket").applyInArrow(answer_weights, WEIGHTS).write.partitionBy("kind", "order").parquet(paths["weights"])
    second = spark.read.schema(WEIGHTS).parquet(paths["weights"]).filter("kind = 'answer'")
    second = second.select("block", "order", "bucket", F.lit(None).cast("binary").alias("n"), F.lit(None).cast("binary").alias("own"), "weights")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        ids = left["ids"].combine_chunks().flatten() if left.num_rows else None
        if ids is None:
            return pa.table([pa.array([], left.schema.field("ids").type.value_type), pa.array([], pa.bool_()), *[pa.array([], pa.int64())] * 3, *[pa.array([], pa.float64())] * 2], names=names)
        block = read_block(left.drop_columns("ids").to_pylist()[0])
        answers = right.to_pylist()
        found = evaluate(Reading(block, answers, model, order), answers)
        return pa.table([ids, pa.array(block.train), pa.array(found["n_tokens"]), pa.array(found["n_known"]), pa.array(np.full(len(ids), model.tokens)), pa.array(found["base_score"]), pa.array(found["score"])], names=names)

    shape = f"_id {id_type}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = blocks.select("ids", *columns).groupBy("block").cogroup(first.unionByName(second).groupBy("block")).applyInArrow(score, shape)
    return scores.withColumnRenamed("_id", id_col)


def model_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(order, key, count) of every n-gram seen in training; keys are the hashes that ``ngram_keys`` gives."""
    rows = spark.read.schema(ANSWERED).parquet(paths["counts"]).filter("kind = 'model'")
    return rows.select("order", F.explode(F.arrays_zip(F.col("model_keys").alias("key"), F.col("model_counts").alias("count"))).alias("m")).select("order", "m.*")


def model_weights(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(order, key, weight): log10 alpha of every context with a follower seen in training."""
    rows = spark.read.schema(WEIGHTS).parquet(paths["weights"]).filter("kind = 'model'")
    return rows.select("order", F.explode(F.arrays_zip(F.col("model_keys").alias("key"), F.col("model_weights").alias("weight"))).alias("m")).select("order", "m.*")


def ngram_keys(text: str | None, order: int) -> list[np.ndarray]:
    """The key of the n-gram that ends at each token of a text, for n from 1 to ``order``."""
    words = Words.of([(text or "").encode()], lower=True)
    tokens = np.append(words.hashes[words.ids], END) if words.size else np.array([END])
    grams = Block(0, tokens, np.array([len(tokens)]), np.array([True])).orders(order)
    return [g.keys[g.place].view(np.int64) for g in grams]


def _model(totals: dict, documents: int, order: int) -> Model:
    row = lambda k: [totals[k][f"s{i}"] for i in range(MOST + 3)] if k in totals else [0] * (MOST + 3)
    words, tokens, *seen = row(1)
    made = Model(tokens, words, documents, [discounts(row(k)[2:]) for k in range(1, order + 1)])
    lost = sum((1 - made.discounts[0][r]) * r * seen[r - 1] for r in range(1, MOST + 1))
    made.unknown = (lost + SPARE) / (tokens + SPARE)
    return made
