"""Quality rules: fixed counts, and a hashed n-gram classifier with calibrated probabilities.

Features are hashed word unigrams, word bigrams and byte n-grams inside words, each group as a share of the text's words,
so that every text is read whole whatever its length. Logistic regression is fitted on labelled rows, a held-out part of
them calibrates the margin (Platt scaling), and whole batches are scored against a fixed threshold. The weight table has
a fixed size (2**BITS floats), so sending it to every task is bounded.

SAMPLE and SAMPLE_BYTES bound the labelled rows that are fitted, one for each id: those with the smallest hash of their id. Without labels of both kinds
there is no classifier, and the counts alone decide. Null texts count as empty (no words: failed). Repeated label rows of
a document vote; null labels are ignored. Equal texts get equal results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .words import Words, as_bytes, mix, slices

BITS = 17
SAMPLE = 4096
#: Text of the labelled rows that are fitted, in bytes.
SAMPLE_BYTES = 32 << 20
GRAMS = (2, 3, 4)
ROUNDS = 20
RIDGE = 1e-5
#: A text is kept if its calibrated probability of good quality is at least this.
KEEP_AT = 0.4
# Fixed values of the counts.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SALT = {"word": 0x9E3779B97F4A7C15, "pair": 0xC2B2AE3D27D4EB4F, "gram": 0x165667B19E3779F9}


# -- counts ---------------------------------------------------------------------------------------------------------------


def repeated_words(words: Words, n: int = 3) -> np.ndarray:
    """For each text, the words that lie in a window of n words which occurs twice or more in that text."""
    at = words.windows(n)
    if not len(at):
        return np.zeros(len(words.counts), np.int64)
    width = max(1, int(words.size - 1).bit_length())
    if n * width <= 63:
        key = np.zeros(len(at), np.int64)
        for k in range(n):
            key = key << width | words.ids[at + k]
    else:  # too many distinct words for one number: number the windows step by step
        key = words.ids[at]
        for k in range(1, n):
            key = np.unique(key * words.size + words.ids[at + k], return_inverse=True)[1]
    # Windows that occur once in the whole batch drop out before the exact comparison inside each text.
    slot = (mix(key.view(np.uint64)) >> np.uint64(64 - 20)).astype(np.int64)
    seen = np.bincount(slot, minlength=1 << 20)
    maybe = np.flatnonzero(seen[slot] > 1)
    doc, key = words.doc[at[maybe]], key[maybe]
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    same = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(words.ids) + 1, np.int64)
    starts = at[maybe[order[twice]]]
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + n, -1)
    return words.per_text((np.cumsum(covered[:-1]) > 0).astype(np.int64))


def counts(words: Words) -> dict[str, np.ndarray]:
    data, starts, lengths = words.joined
    each = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points before each byte
    symbol = np.append(0, np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8))))
    over = lambda total: (total[starts + lengths] - total[starts])[words.ids] if words.size else words.ids
    lines = [[y for y in x.split(b"\n") if y.strip()] for x in words.raw]
    return {
        "n_words": words.counts,
        "word_chars": words.per_text(over(each)),
        "n_symbols": words.per_text(over(symbol)),
        "n_dup_lines": np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, len(lines)),
        "n_repeat_words": repeated_words(words),
    }


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])


# -- features -------------------------------------------------------------------------------------------------------------


@dataclass
class Features:
    """Hashed features of a batch: of each distinct word (byte n-grams included), and of each pair of neighbours."""

    words: Words
    word_slots: np.ndarray
    gram_slots: np.ndarray
    gram_owner: np.ndarray
    pair_at: np.ndarray
    pair_slots: np.ndarray

    @classmethod
    def of(cls, words: Words) -> Features:
        data, starts, lengths = words.joined
        n = words.size
        slots, owners, whole = [], [], np.zeros(n, np.uint64)
        wide = data.astype(np.uint64)
        owner = np.repeat(np.arange(n), lengths + 1)  # of each byte and the space before it
        end = (starts + lengths)[owner] if n else np.empty(0, np.int64)  # the space after
        at = np.arange(len(owner))
        for size in GRAMS:
            fits = at[at + size - 1 <= end]
            key = np.full(len(fits), size, np.uint64)
            for k in range(size):
                key = key << np.uint64(8) | wide[fits + k]
            key = mix(key ^ np.uint64(_SALT["gram"]))
            slots.append(key >> np.uint64(64 - BITS))
            owners.append(owner[fits])
            if size == max(GRAMS) or size == 2:  # a word's own hash comes from the places of its n-grams
                place = (fits - starts[owner[fits]] + 2).astype(np.uint64)
                np.add.at(whole, owner[fits], mix(key ^ place * np.uint64(_SALT["word"])))
        pair_at = words.windows(2)
        pair = mix(whole[words.ids[pair_at]] * np.uint64(3) + mix(whole[words.ids[pair_at + 1]] ^ np.uint64(_SALT["pair"]))) if n else np.empty(0, np.uint64)
        down = lambda x: (x >> np.uint64(64 - BITS)).astype(np.int64)
        return cls(words, down(mix(whole ^ np.uint64(_SALT["word"]))), np.concatenate(slots).astype(np.int64), np.concatenate(owners), pair_at, down(pair))

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Per text: bias plus the mean weight over words, over byte n-grams and over pairs."""
        words = self.words
        gram = np.bincount(self.gram_owner, weights[self.gram_slots], words.size)
        grams = np.bincount(self.gram_owner, minlength=words.size)
        share = lambda total, n: total / np.maximum(n, 1)
        pair_doc = words.doc[self.pair_at]
        n = len(words.counts)
        return (
            bias
            + share(words.per_text(weights[self.word_slots][words.ids]), words.counts)
            + share(words.per_text(gram[words.ids]), words.per_text(grams[words.ids]))
            + share(np.bincount(pair_doc, weights[self.pair_slots], n), np.bincount(pair_doc, minlength=n))
        )

    def sparse(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text the slots and values whose product with the weights is the margin; for fitting."""
        words, out = self.words, []
        order = np.argsort(self.gram_owner, kind="stable")
        slots = self.gram_slots[order]
        ends = np.cumsum(np.bincount(self.gram_owner, minlength=words.size))
        stops = np.cumsum(words.counts)
        pair_stops = np.cumsum(np.bincount(words.doc[self.pair_at], minlength=len(words.counts)))
        for i, (stop, n) in enumerate(zip(stops.tolist(), words.counts.tolist(), strict=True)):
            own, times = np.unique(words.ids[stop - n : stop], return_counts=True)
            size = np.diff(ends, prepend=0)[own] if len(own) else own
            grams = np.concatenate([slots[e - s : e] for e, s in zip(ends[own].tolist(), size.tolist(), strict=True)] or [np.empty(0, np.int64)])
            value = np.repeat(times, size) / max(1, int((times * size).sum()))
            a = pair_stops[i - 1] if i else 0
            pairs = self.pair_slots[a : pair_stops[i]]
            slot = np.concatenate([self.word_slots[own], grams, pairs])
            val = np.concatenate([times / max(n, 1), value, np.full(len(pairs), 1 / max(1, len(pairs)))])
            used, where = np.unique(slot, return_inverse=True)
            out.append((used, np.bincount(where, val, len(used))))
        return out


# -- the classifier -------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float  # calibration: probability = sigmoid(slope * margin + offset)
    offset: float
    rows: int

    def probability(self, features: Features) -> np.ndarray:
        return sigmoid(self.slope * features.margins(self.weights, self.bias) + self.offset)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def labelled_features(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Sparse features of at most ``sample`` labelled documents of ``most_bytes`` of text together: one row for each id
    (of repeated ones, that whose text has the least hash), in the order of a hash of the id, up to the first that would
    go over."""
    votes = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    chosen = votes.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    one = written(known.groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")), "labelled")
    size = F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")
    upto = F.sum("_size").over(Window.orderBy(F.xxhash64("_id"), "_id"))  # at most ``sample`` rows, without their texts
    fits = one.select("_id", size.alias("_size")).withColumn("_upto", upto).filter(F.col("_upto") <= most_bytes)
    rows = one.join(F.broadcast(fits.select("_id")), "_id").select("_id", "_label", "_text")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found = Features.of(Words.of(as_bytes(part.column(2)))).sparse()
                arrays = [pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["_id", "_label", "slots", "vals"])

    return rows.mapInArrow(run, f"_id {kind}, _label int, slots array<int>, vals array<float>")


def fit(features: DataFrame) -> Model | None:
    """Fits on three of four rows by hash of the id and calibrates on the fourth; None without both labels in both parts.

    The bounded sample meets in one task, which returns the model alone, so no features pass through the driver.
    """
    folds = features.select("_id", "_label", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(4)).alias("_fold"), "slots", "vals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _fitted(sorted(_examples(batches), key=lambda x: x[0]))
        if model:
            columns = [[model.weights.tobytes()], [model.bias], [model.slope], [model.offset], [model.rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["weights", "bias", "slope", "offset", "rows"])

    made = folds.repartition(1).mapInArrow(run, "weights binary, bias double, slope double, offset double, rows long").collect()
    return Model(np.frombuffer(made[0]["weights"], np.float32), *made[0][1:]) if made else None


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4), strict=True):
            yield *row[:3], row[3].values.to_numpy().copy(), row[4].values.to_numpy().copy()


def _fitted(rows: list[tuple[object, int, int, np.ndarray, np.ndarray]]) -> Model | None:
    label, held = np.array([x[1] for x in rows], np.float64), np.array([x[2] == 0 for x in rows], bool)
    if any(len(set(label[x])) < 2 for x in (held, ~held)):
        return None
    parts, start, n = [], 0, len(rows)  # runs of rows, so that the arithmetic needs little room besides the sample
    sizes = np.array([len(x[3]) for x in rows])
    for stop in range(1, n + 1):
        if stop == n or sizes[start:stop].sum() >= 1 << 18:
            own = np.repeat(np.arange(start, stop, dtype=np.int32), sizes[start:stop])
            parts.append((own, np.concatenate([x[3] for x in rows[start:stop]]), np.concatenate([x[4] for x in rows[start:stop]])))
            rows[start:stop] = [None] * (stop - start)  # a run takes the place of its rows: the sample is held once
            start = stop
    rows.clear()
    share = label[~held].mean()
    weight = np.where(held, 0.0, np.where(label == 1, 0.5 / share, 0.5 / (1 - share))) / (~held).sum()

    def margins(theta: np.ndarray) -> np.ndarray:
        return sum(np.bincount(own, val * theta[slot], n) for own, slot, val in parts) + theta[-1]

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted log loss and its gradient; the last parameter is the bias."""
        margin = margins(theta)
        error = (sigmoid(margin) - label) * weight
        grad = RIDGE * theta
        for own, slot, val in parts:
            grad += np.bincount(slot, val * error[own], len(theta))
        grad[-1] = error.sum()
        return float(weight @ (np.logaddexp(0, margin) - label * margin)) + RIDGE / 2 * float(theta[:-1] @ theta[:-1]), grad

    theta = minimise(loss, np.zeros((1 << BITS) + 1), ROUNDS)
    margin = margins(theta)
    slope, offset = platt(margin[held], label[held])
    return Model(theta[:-1].astype(np.float32), float(theta[-1]), slope, offset, n)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halving steps; each round costs one evaluation, or few."""
    value, grad = loss(theta)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []  # change of place, of gradient, and their product
    for _ in range(rounds):
        way, saved = -grad, []
        for s, y, sy in reversed(steps):
            saved.append(a := float(s @ way) / sy)
            way = way - a * y
        if steps:
            _, y, sy = steps[-1]
            way = way * (sy / float(y @ y))
        for (s, y, sy), a in zip(steps, reversed(saved), strict=True):
            way = way + (a - float(y @ way) / sy) * s
        slope, size = float(grad @ way), 1.0 if steps else 1 / max(float(np.abs(grad).max()), 1e-12)
        for _ in range(30):
            there, (low, new) = theta + size * way, loss(theta + size * way)
            if low <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return theta
        s, y = there - theta, new - grad
        if float(s @ y) > 1e-12:
            steps = [*steps, (s, y, float(s @ y))][-memory:]
        theta, value, grad = there, low, new
    return theta


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Newton steps for the two calibration parameters, on targets drawn in from 0 and 1 by the class sizes."""
    up, down = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    spread = margin.std() or 1.0
    x = np.stack([margin / spread, np.ones_like(margin)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ theta)
        grad = x.T @ (p - target) + 1e-3 * theta
        theta = theta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    return float(theta[0] / spread), float(theta[1])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, base_failed, probability (null without a model) and kept."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                words = Words.of(as_bytes(part.column(1)))
                found = counts(words)
                failed = base_failed(found)
                p = model.probability(Features.of(words)) if model else None
                arrays = [pa.array(found[c].astype(np.int64)) for c in COUNTS]
                arrays += [pa.array(failed), pa.array(p, pa.float64()) if model else pa.nulls(len(failed), pa.float64()), pa.array(~failed & (p >= KEEP_AT) if model else ~failed)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["_id", *COUNTS, "base_failed", "probability", "kept"])

    shape = f"_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, probability double, kept boolean"
    return slim.mapInArrow(run, shape).withColumnRenamed("_id", id_col)


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score`` keeps."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                words = Words.of(as_bytes(part.column(at)))
                kept = ~base_failed(counts(words))
                if model:
                    kept &= model.probability(Features.of(words)) >= KEEP_AT
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fits on the labelled rows, then scores every document."""
    return score(docs, fit(labelled_features(docs, labels, sample, id_col=id_col, text_col=text_col)), id_col, text_col)
