"""Language identification by fusing evidence in one posterior.

For a row with text t, declared language d, address suffix s and host h, and for each language L known to the model:

    log P(L | t, d, s, h) = text(t, L) + log P(d | L) + log P(s | L) + log P(L | h) + const

* text: byte n-grams of the lower-cased words under a hashed, smoothed model per language, tempered by the square root of
  the length (neighbouring n-grams are far from independent). The model is fitted on a bounded sample of the distinct
  texts whose declared language is known: SAMPLE of each language at most, those of least hash. Every declared tag of the
  form of a language subtag (2 to 8 letters) with LEAST distinct texts or more is a language; the model has six bytes for
  each of its slots. Text that is foreign to all of them goes to UNKNOWN, under which all n-grams are alike.
* P(d | L), P(s | L): smoothed tables of how often rows whose text alone points to L declare d or have suffix s.
* P(L | h): host counts smoothed towards the registered domain's, those towards the whole table's.

A row has a score for each language, so languages cost time and room in proportion to their number.

All tables but the text model come from grouped aggregation over all rows. Rows are joined to their host's prior from a
written table, so that adaptive execution can broadcast it if it is small and split a hot host if it is not.

A null or empty text, declaration, suffix or host adds no evidence; a row with none has the global prior. Rows are kept
if the text has a letter and the best class is a language and has at least KEEP_AT; equal rows get equal results. An empty
table gives no rows; where no language can be fitted, language and posterior are null and no row is kept. Columns to
carry may have any names but those of the evidence and of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from .common import written
from .words import Words, as_bytes, mix, slices

BITS = 15
SAMPLE = 512
#: Bits of the text hash that the sample is drawn by.
RANGE = 48
GRAMS = (1, 2, 3)
SMOOTH = 0.5
#: Rows that a broader level counts for in a narrower one.
STRENGTH = 8.0
#: Weight of one square-root-tempered n-gram.
TEMPER = 1.5
KEEP_AT = 0.5
#: Distinct texts that make a declared tag a language.
LEAST = 4
#: Scores, texts times languages, that a task holds at once.
CELLS = 1 << 22
OTHER, UNKNOWN = "other", "und"
_READ = StructType([StructField("n_words", LongType()), StructField("letters", BooleanType()), StructField("evidence", ArrayType(DoubleType()))])


@dataclass
class TextModel:
    """A smoothed table of each language, of which only the slots seen are stored: a few kilobytes for a tag of a few texts."""

    languages: list[str]
    begins: np.ndarray  # of each language's slots, and the end
    slots: np.ndarray
    weights: np.ndarray  # log probability of each slot
    floors: np.ndarray  # of each language: log probability of a slot that is not seen

    def table(self, k: int) -> np.ndarray:
        """Log probability of every slot under a language."""
        own = slice(self.begins[k], self.begins[k + 1])
        out = np.full(1 << BITS, self.floors[k], np.float32)
        out[self.slots[own]] = self.weights[own]
        return out

    def scores(self, words: Words) -> np.ndarray:
        """Tempered log likelihood, texts x languages and UNKNOWN, with the best at 0."""
        slots, owner = gram_slots(words)
        n = len(words.counts)
        out = np.zeros((n, len(self.languages) + 1))
        if len(slots):
            grams = np.bincount(owner, minlength=words.size)
            size = words.per_text(grams[words.ids])
            root = np.sqrt(np.maximum(size, 1))
            for k in range(len(self.languages)):
                each = np.bincount(owner, self.table(k)[slots], words.size)
                out[:, k] = words.per_text(each[words.ids]) * TEMPER / root
            out[:, -1] = -BITS * np.log(2) * size * TEMPER / root
        return out - out.max(axis=1, keepdims=True) if n else out


def gram_slots(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of the distinct words, with their bounding spaces, and the word each belongs to."""
    data, starts, lengths = words.joined
    if not words.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(words.size), lengths + 1)
    end = (starts + lengths)[owner]
    at, wide = np.arange(len(owner)), data.astype(np.uint64)
    slots, owners = [], []
    for size in GRAMS:
        fits = at[at + size - 1 <= end]
        key = np.full(len(fits), size, np.uint64)
        for k in range(size):
            key = key << np.uint64(8) | wide[fits + k]
        slots.append((mix(key) >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[fits])
    return np.concatenate(slots), np.concatenate(owners)


def sampled(rows: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> tuple[DataFrame, dict[str, int]]:
    """(declared, text): of each language the ``sample`` distinct texts of least hash, or all if there are fewer; and the
    number of distinct texts of each. Copies count once, so a hot text weighs as any other."""
    key = F.pmod(F.xxhash64("text"), F.lit(1 << RANGE))
    known = rows.filter(F.col("declared").isNotNull() & F.col("text").isNotNull()).select("declared", "text", key.alias("_h"))
    distinct = known.groupBy("declared", "_h").agg(F.lit(1)).groupBy("declared").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["declared"]: r["n"] for r in distinct.filter(F.col("n") >= least).collect()}
    if not sizes:
        return known.select("declared", "text").limit(0), sizes
    # A threshold that twice the sample is expected to pass (fewer than the sample: a chance below 1e-60 at 512), made one
    # row a text in the tasks, then the exact cut on the few that pass.
    bound = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1 << RANGE, math.ceil(2 * sample / n * (1 << RANGE)))))])
    few = known.filter(F.col("_h") < bound[F.col("declared")]).groupBy("declared", "_h").agg(F.min("text").alias("text"))
    own = Window.partitionBy("declared").orderBy("_h")
    return few.withColumn("_rn", F.row_number().over(own)).filter(F.col("_rn") <= sample).select("declared", "text"), sizes


def fit_text(rows: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> TextModel:
    """``rows``: text, declared (null: unlabelled). Slots are counted by language in the tasks and summed by a grouped
    aggregate, so the driver gets one small row for each slot that a language has."""
    part, sizes = sampled(rows, sample, least)
    languages = sorted(sizes)
    number = {k: i for i, k in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                label = np.array([number[x] for x in piece.column(0).to_pylist()], np.int64)
                keys, n = slot_counts(Words.of(as_bytes(piece.column(1)), lower=True), label)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> BITS, pa.int32()), pa.array(keys & (1 << BITS) - 1, pa.int32()), pa.array(n)], names=["k", "slot", "n"])

    if not languages:
        return TextModel([], np.zeros(1, np.int64), np.empty(0, np.uint16), np.empty(0, np.float32), np.empty(0))
    found = part.mapInArrow(run, "k int, slot int, n double").groupBy("k", "slot").agg(F.sum("n").alias("n")).toArrow().sort_by("k")
    k, n = found["k"].to_numpy(), found["n"].to_numpy()
    total = np.log(np.bincount(k, n, len(languages)) + SMOOTH * (1 << BITS))
    begins = np.searchsorted(k, np.arange(len(languages) + 1))
    return TextModel(languages, begins, found["slot"].to_numpy().astype(np.uint16), (np.log(n + SMOOTH) - total[k]).astype(np.float32), np.log(SMOOTH) - total)


def slot_counts(words: Words, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label << BITS | slot, how often) over the texts of each label."""
    slots, owner = gram_slots(words)
    if not len(slots):
        return np.empty(0, np.int64), np.empty(0)
    order = np.argsort(owner, kind="stable")
    slots, grams = slots[order], np.bincount(owner, minlength=words.size)
    begin = np.cumsum(grams) - grams
    pairs, often = np.unique(label[words.doc] * words.size + words.ids, return_counts=True)
    own, word = np.divmod(pairs, words.size)
    many = grams[word]
    at = np.repeat(begin[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    keys, place = np.unique(np.repeat(own << BITS, many) | slots[at], return_inverse=True)
    return keys, np.bincount(place, np.repeat(often, many), len(keys))


def read_text(rows: DataFrame, model: TextModel, carry: list[str]) -> DataFrame:
    """``carry`` columns, n_words, letters and the text scores of every row."""
    slim = rows.select(*carry, F.col("text").alias("_text"))
    names = [*slim.columns[:-1], "n_words", "letters", "evidence"]
    shape = StructType([*slim.schema.fields[:-1], *_READ.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(slices(batch, batch.num_columns - 1), 1 + CELLS // (1 + len(model.languages))):
                raw = as_bytes(part.column(part.num_columns - 1))
                words = Words.of(raw, lower=True)
                scores = model.scores(words)
                letters = [any(map(str.isalpha, x.decode())) for x in raw]
                ends = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * scores.shape[1])
                arrays = [pa.array(words.counts), pa.array(letters, pa.bool_()), pa.ListArray.from_arrays(ends, pa.array(scores.ravel()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=names)

    return slim.mapInArrow(run, shape)


def rows_of(parts: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The parts in runs of at most so many rows."""
    for part in parts:
        for at in range(0, part.num_rows, most):
            yield part.slice(at, most)


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), 2), ".")


def identify(rows: DataFrame, carry: list[str], sample: int = SAMPLE, keep_at: float = KEEP_AT, least: int = LEAST) -> DataFrame:
    """``rows``: text, declared, suffix, host and the columns to carry. Adds language, posterior, text_language,
    n_words, evidence per language and kept."""
    primary = F.lower(F.regexp_extract("declared", "^[A-Za-z]{2,8}(?![A-Za-z])", 0))
    clean = rows.withColumns({"declared": F.when(~primary.isin("", UNKNOWN), primary), "host": F.nullif(F.lower("host"), F.lit("")), "suffix": F.nullif(F.lower("suffix"), F.lit(""))})
    model = fit_text(clean.select("declared", "text"), sample, least)
    if not model.languages:
        return rows.select(*carry, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_language"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("map<string,double>").alias("posteriors"), F.lit(False).alias("kept"))
    names = F.array(*map(F.lit, [*model.languages, UNKNOWN]))
    n = len(model.languages) + 1
    tag = F.when(F.col("declared").isNull() | F.col("declared").isin(model.languages), F.col("declared")).otherwise(F.lit(OTHER))
    read = written(read_text(clean.withColumns({"_declared": tag, "_suffix": F.col("suffix"), "_host": F.col("host"), "_domain": domain_of(F.col("host"))}), model, [*carry, "_declared", "_suffix", "_host", "_domain"]), "language")
    best = F.array_position("evidence", F.array_max("evidence")).cast("int") - 1
    voters = read.filter("letters").select("_declared", "_suffix", "_host", "_domain", best.alias("_k"))

    def counts(*key: str) -> DataFrame:
        """Votes by key as an array over the languages, counted as rows of (key, language) first."""
        votes = voters.filter(F.col(key[0]).isNotNull()).groupBy(*key, "_k").agg(F.count(F.lit(1)).cast("double").alias("v"))
        found = votes.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_k", "v"))).alias("m"))
        return found.select(*key, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("c"))

    overall = [0.0] * n  # one row for each language
    for r in voters.groupBy("_k").count().collect():
        overall[r["_k"]] = float(r["count"])
    prior = np.array(overall) + 1
    prior = (prior / prior.sum()).tolist()
    base = F.array(*map(F.lit, prior))

    def likelihood(table: DataFrame) -> DataFrame:
        """log P(value | language), up to what all values share: counts over the language's, smoothed by STRENGTH rows."""
        return table.withColumn("e", F.zip_with("c", F.array(*map(F.lit, overall)), lambda c, t: F.log((c + 1) / (t + STRENGTH))))

    declared = likelihood(counts("_declared")).select("_declared", F.col("e").alias("_ed"))  # one row for each language, and one for OTHER
    suffixes = written(likelihood(counts("_suffix")).select("_suffix", F.col("e").alias("_es")), "suffixes")
    smooth = lambda c, towards: F.zip_with(c, towards, lambda a, b: (a + STRENGTH * b) / (F.aggregate(c, F.lit(0.0), lambda s, y: s + y) + STRENGTH))
    domains = counts("_domain").select("_domain", smooth(F.col("c"), base).alias("_pd"))
    hosts = written(counts("_host", "_domain").join(domains, "_domain").select("_host", F.transform(smooth(F.col("c"), F.col("_pd")), lambda p: F.log(p)).alias("_ep")), "hosts")
    add = lambda a, b: F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    joined = read.join(F.broadcast(declared), "_declared", "left").join(suffixes, "_suffix", "left").join(hosts, "_host", "left")
    fused = add(add(add(F.col("evidence"), F.col("_ed")), F.col("_es")), F.coalesce("_ep", F.array(*[F.log(F.lit(p)) for p in prior])))
    shifted = F.transform("_f", lambda x: F.exp(x - F.array_max("_f")))
    out = joined.withColumn("_f", fused).withColumn("_f", shifted).withColumn("_f", F.transform("_f", lambda x: x / F.aggregate("_f", F.lit(0.0), lambda s, y: s + y)))
    at = F.array_position("_f", F.array_max("_f")).cast("int") - 1
    return out.select(
        *carry,
        names[at].alias("language"),
        F.array_max("_f").alias("posterior"),
        F.when(F.col("letters"), names[best]).alias("text_language"),
        "n_words",
        F.map_from_arrays(names, F.col("_f")).alias("posteriors"),
        (F.col("letters") & (F.array_max("_f") >= keep_at) & (names[at] != UNKNOWN)).alias("kept"),
    )


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents declare their language in ``lang``; their ``source`` is the host. All columns stay."""
    return docs.withColumns({"declared": F.col("lang"), "host": F.col("source"), "suffix": F.lit(None).cast("string")})


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``identify`` keeps."""
    whole = document_evidence(docs.select("text", "lang", "source", F.struct(*docs.columns).alias("_row")))
    return identify(whole, ["_row"]).filter("kept").select("_row.*")


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages declare it in the markup's lang attribute; host and suffix come from the address."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    # What is not closed reaches to the end, so that no place is searched twice.
    plain = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b[^>]*(?:>.*?(?:</\1\s*>|\z)|\z)", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"<[^<>]*>", " "), r"&[A-Za-z0-9#]{1,32};", " ")
    return pages.withColumns({"text": plain, "declared": F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), "host": host, "suffix": F.regexp_extract(host, r"\.([a-z]+)$", 1)})
