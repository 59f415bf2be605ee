"""Internal-link recommendation: vector and word candidates, scores, and a constrained choice."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import confidence_label, opportunity_type
from ..functions.keys import compared_url
from ..functions.measures import clamp, half_up, unit
from ..functions.text import STOP_WORDS, link_tokens
from .choice import MOST_LINKS, choose  # noqa: F401
from .words_met import word_candidates  # noqa: F401

LEAST_SIMILARITY = 0.58
LEAST_SCORE = 50
#: Probability that hashed tables meet a pair at the least similarity, and the seed of their projections.
LEAST_RECALL, SEED = 0.95, 1729


def nearest(targets: DataFrame, items: DataFrame, k: int, least: float = LEAST_SIMILARITY, dims: int = 64, planes: int = 0, recall: float = LEAST_RECALL) -> DataFrame:
    """(target, item, similarity): the ``k`` nearest items of each target with at least ``least`` cosine similarity.

    ``planes`` = 0 compares all; targets are a stated query set, and Spark's own size check decides on a broadcast. Blocks of
    vectors meet, each pair as a product of matrices, and only a target's nearest of a block go on. With planes, vectors meet only where they share a cell in one of several tables, a cell being the signs of so many random
    projections. Two vectors at an angle t share a sign with probability 1 - t / pi, so the number of tables follows from
    ``planes``, ``least`` and ``recall``: a pair at ``least`` is met with probability ``recall``, a nearer pair with a
    greater one. The lower ``least``, the more tables, and the less is saved against comparing all."""
    a = targets.select("target", unit(F.col("vector")).alias("a")).filter("a is not null")
    b = items.select("item", unit(F.col("vector")).alias("b")).filter("b is not null")
    if planes:
        cells = lambda v: hashed_cells(v, dims, planes, table_count(planes, least, recall))
        a, b = a.withColumn("cells", cells(F.col("a"))), b.withColumn("cells", cells(F.col("b")))
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Both sides are dealt out when they are packed, since each part of one is read for each part of the other.
    pairs = _packed(a, "target", "a").repartition(n).hint("shuffle_replicate_nl").join(_packed(b, "item", "b").repartition(1 + n // 16))
    shape = f"target {a.schema['target'].dataType.simpleString()}, item {b.schema['item'].dataType.simpleString()}, similarity double, _shown double"
    scored = pairs.mapInPandas(_best_of(k, least), shape)
    own = Window.partitionBy("target").orderBy(F.desc("_shown"), F.asc("item"))
    return scored.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= k).drop("_shown")


#: Vectors of a block; two blocks meet in one product of matrices.
PACK = 2000


def _packed(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Blocks of vectors of one length: their keys in order, and vectors and cells as bytes."""

    def pack(batches):
        for whole in batches:
            for _, same in whole.groupby(whole[vector].map(len)):
                ordered = same.sort_values(key)
                for at in range(0, len(ordered), PACK):
                    part = ordered.iloc[at : at + PACK]
                    cells = np.stack(part["cells"]).astype(np.int32).tobytes() if "cells" in part else b""
                    yield pd.DataFrame({f"{key}s": [part[key].tolist()], vector: [np.stack(part[vector]).astype(float).tobytes()], f"{key}_cells": [cells]})

    return rows.mapInPandas(pack, f"{key}s array<{rows.schema[key].dataType.simpleString()}>, {vector} binary, {key}_cells binary")


def _best_of(k: int, least: float):
    """Of each target of a pair of blocks, its ``k`` nearest items there. Equal vectors differ in the last digits of a
    product, so that nine digits decide, then the key."""

    def best(batches):
        for whole in batches:
            for r in whole.itertuples(index=False):
                x, y = (np.frombuffer(v).reshape(len(keys), -1) for v, keys in ((r.a, r.targets), (r.b, r.items)))
                if x.shape[1] != y.shape[1]:
                    continue
                with np.errstate(invalid="ignore"):
                    found = x @ y.T
                near = (found >= least) | np.isnan(found)  # as Spark compares
                if r.target_cells:
                    ca, cb = (np.frombuffer(v, np.int32).reshape(len(keys), -1) for v, keys in ((r.target_cells, r.targets), (r.item_cells, r.items)))
                    i, j = np.nonzero(near)
                    met = np.concatenate([(ca[i[at : at + 100_000]] == cb[j[at : at + 100_000]]).any(axis=1) for at in range(0, len(i), 100_000)] or [np.zeros(0, bool)])
                    near[i[~met], j[~met]] = False
                shown, kept = np.round(found, 9), []
                for t in np.nonzero(near.any(axis=1))[0]:
                    own = np.nonzero(near[t])[0]
                    rank = np.where(np.isnan(shown[t, own]), np.inf, shown[t, own])
                    kept += [(t, i) for i in own[np.argsort(-rank, kind="stable")[:k]]]
                if kept:
                    t, i = map(np.array, zip(*kept, strict=True))
                    yield pd.DataFrame({"target": np.asarray(r.targets, object)[t], "item": np.asarray(r.items, object)[i], "similarity": found[t, i], "_shown": shown[t, i]}).infer_objects()

    return best


def table_count(planes: int, least: float, recall: float) -> int:
    """Tables that meet a pair at ``least`` with probability ``recall``."""
    same = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** planes
    return 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log(1 - same))


def hashed_cells(vector: Column, dims: int, planes: int, tables: int) -> Column:
    """The cell of a vector in each table: the signs of ``planes`` seeded normal projections as the bits of a number."""
    drawn = np.random.default_rng(SEED).normal(size=(tables, planes, dims))

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            v = np.asarray(v, float)[:dims]
            out.append(((drawn[:, :, : len(v)] @ v > 0) << np.arange(planes)).sum(axis=1).astype(np.int32))
        return pd.Series(out)

    return cells(vector)


# Sentences that are not embedded, the tokens of each, those of a review, and what a million of them costs in
# the currency of the price lists, by a part of the provider's or model's name; the empty one is any other.
MOST_LINKED, MOST_BOILERPLATE = 0.35, 0.65
LEAST_TOKENS, NO_SENTENCE, REVIEW_TOKENS = 12, 120, 450
FREE_PROVIDERS = ("local", "local-rules", "ollama")
EMBEDDING_PRICES = (("cohere", 0.10), ("voyage", 0.12), ("jina", 0.02), ("gemini", 0.15), ("", 0.02))
REVIEW_PRICES = (("anthropic", 0.80), ("gemini", 0.15), ("openrouter", 0.30), ("", 0.20))


def price(name: str, prices: tuple[tuple[str, float], ...]) -> float:
    """Of a million tokens; ``name`` is a provider, or a provider and a model with a colon between."""
    name = name.strip().lower()
    return 0.0 if name.split(":")[0] in ("", *FREE_PROVIDERS) else next(n for part, n in prices if part in name)


def estimate(sentences: DataFrame, by: list[str], max_pages: int = 1000, max_sentences: int = 50, most_links: int = 500, embedding: str = "local", review: str = "local") -> DataFrame:
    """What a run of the recommender over each group of sentences would take: ``by``, pages, sentences, embedding_tokens,
    review_tokens, embedding_cost, review_cost and total_cost.

    ``sentences``: ``by``, page_key, sentence, and where they are known link_density and boilerplate. The bounds are those of
    the run: pages, sentences of a page, and links to review. One aggregate, counted in the tasks first."""
    max_pages, max_sentences, most_links = min(max(max_pages, 1), 10_000), min(max(max_sentences, 1), 250), min(max(most_links, 1), 1000)
    rows = sentences
    if "link_density" in rows.columns:
        rows = rows.filter(F.coalesce("link_density", F.lit(0.0)) <= MOST_LINKED)
    if "boilerplate" in rows.columns:
        rows = rows.filter(F.coalesce("boilerplate", F.lit(0.0)) < MOST_BOILERPLATE)
    each = rows.groupBy(*by, "page_key").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("sentence")), F.lit(0)).alias("chars"))
    all_ = each.groupBy(*by).agg(F.count("page_key").alias("p"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    pages = F.least(F.col("p"), F.lit(max_pages))
    count = F.least(F.col("n"), pages * max_sentences)
    size = F.when(count > 0, F.col("chars") / F.col("n")).otherwise(float(NO_SENTENCE))
    tokens = F.floor(count * F.greatest(F.lit(float(LEAST_TOKENS)), size / 4) + 0.5)
    out = all_.select(*by, pages.alias("pages"), count.alias("sentences"), tokens.alias("embedding_tokens"), F.lit(most_links * REVIEW_TOKENS).cast("long").alias("review_tokens"))
    cost = lambda c, x: F.col(c) / 1_000_000 * x
    out = out.withColumns({"embedding_cost": cost("embedding_tokens", price(embedding, EMBEDDING_PRICES)), "review_cost": cost("review_tokens", price(review, REVIEW_PRICES))})
    return out.withColumn("total_cost", F.col("embedding_cost") + F.col("review_cost"))


# Addresses that are no pages, and pages that are not linked.
ASSET_URL = r"(?i)\.(?:avif|css|gif|ico|jpe?g|js|json|mov|mp3|mp4|pdf|png|svg|webm|webp|woff2?|xml|zip)(?:[?#].*)?$"
ASSET_PATH = r"(?i)/(?:wp-content/uploads|uploads|assets|static|media)/"
UTILITY_PAGE = r"(?i)/(?:privacy-policy|privacy|politika-privatnosti|datenschutz|terms|uvjeti|legal|impressum|cookie|cookies|login|account|cart|checkout|thank-you|search|tag|category|author|feed|attachment|wp-json)(?:/|$)|/page/\d+(?:/|$)|[?&](?:filter|sort|s|q|replytocom)="
HOME_PAGE = r"(?i)^/(?:[a-z]{2}(?:-[a-z]{2})?/)?(?:home|homepage|startseite)?/?$"
# Words that make no anchor alone, and those that weaken a short one.
GENERIC_WORDS = frozenset(("activities", "activity", "adventure", "article", "blog", "click", "content", "details", "guide", "home", "information", "learn", "link", "overview", "page", "park", "post", "resource", "resources", "route", "service", "services", "site", "solution", "solutions", "trail", "website"))
WEAK_WORDS = frozenset(("article", "blog", "click", "content", "details", "information", "link", "overview", "page", "post", "resource", "resources", "service", "services", "solution", "solutions", "website"))


def page_tests(pages: DataFrame) -> DataFrame:
    """Adds indexable, source_ok and target_ok; columns status_code and content_type are tested where they are there."""
    place = F.concat_ws(" ", "url", "page_key")
    away = (F.coalesce("canonical_url", F.lit("")) != "") & (compared_url(F.col("canonical_url")) != compared_url(F.col("url")))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    empty = (F.coalesce("word_count", F.lit(0)) < 20) & (text("title") == "") & (text("h1_text") == "")
    index = ~place.rlike(ASSET_URL) & ~place.rlike(ASSET_PATH) & ~F.coalesce("noindex", F.lit(False)) & ~away & ~empty
    if "status_code" in pages.columns:
        index &= F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    if "content_type" in pages.columns:
        kind = F.lower(text("content_type"))
        index &= (kind == "") | kind.contains("text/html") | kind.contains("application/xhtml+xml")
    useful = ~place.rlike(UTILITY_PAGE)
    return pages.withColumns({"indexable": index, "source_ok": useful, "target_ok": useful & (F.coalesce("word_count", F.lit(0)) >= 120) & ~F.col("page_key").rlike(HOME_PAGE)})


def likeness(prefix: str = "_") -> list[Column]:
    """What tells that two pages are nearly one: slug, home and heading, of page_key, url, canonical_url, title and h1_text."""
    slug = F.lower(F.element_at(F.split(F.rtrim(F.col("page_key"), F.lit("/")), "/"), -1))
    heading = F.trim(F.regexp_replace(F.lower(F.coalesce(F.nullif("h1_text", F.lit("")), F.col("title"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return [slug.alias(f"{prefix}slug"), compared_url(F.coalesce("canonical_url", "url")).alias(f"{prefix}home"), heading.alias(f"{prefix}heading")]


def apart(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """``pairs`` (source_key, target_key) without pages that are nearly one: same last part of the address, same canonical
    address, or same long heading."""
    own = lambda p: pages.select(F.col("page_key").alias(f"{p}_key"), *likeness(f"_{p}_"))
    both = pairs.join(own("source"), "source_key").join(own("target"), "target_key")
    same = lambda c: (F.col(f"_source_{c}") != "") & (F.col(f"_source_{c}") == F.col(f"_target_{c}"))
    one = same("slug") | same("home") | (same("heading") & (F.length("_source_heading") >= 24))
    return both.filter(~F.coalesce(one, F.lit(False))).select(pairs.columns)


def with_vectors(words: DataFrame, near: DataFrame, sentences: DataFrame, targets: DataFrame, existing: DataFrame) -> DataFrame:
    """``words`` with the similarity of ``near`` (target_key, source_key, similarity; 0 where it has none), and the pairs
    that only ``near`` has, with the first sentence of the source and the tokens that it shares with the target."""
    near = near.filter("target_key <> source_key").join(existing.select(F.col("from_key").alias("source_key"), F.col("to_key").alias("target_key")).distinct(), ["source_key", "target_key"], "left_anti")
    text = sentences.select("source_key", "sentence_id", "sentence")
    seen = words.join(near, ["target_key", "source_key"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0))).join(text, ["source_key", "sentence_id"])
    first = text.groupBy("source_key").agg(F.min(F.struct("sentence_id", "sentence")).alias("s")).select("source_key", "s.*")
    alone = near.join(words.select("target_key", "source_key").distinct(), ["target_key", "source_key"], "left_anti").join(first, "source_key").join(targets.select("target_key", "text"), "target_key")
    shared = F.size(F.array_intersect(F.array_distinct(link_tokens(F.col("text"))), F.array_distinct(link_tokens(F.col("sentence")))))
    columns = ["target_key", "source_key", "sentence_id", "overlap", "similarity", "sentence"]
    return seen.select(columns).unionByName(alone.withColumn("overlap", shared).select(columns))


_WORDS, _TOKENS, _STOPPED = re.compile(r"[^\W_](?:[^\W_]|-){2,}"), re.compile(r"[^\W_]{3,}"), frozenset(STOP_WORDS)


def tokens_of(text: str) -> list[str]:
    """The tokens of ``link_tokens`` for one text."""
    return [t for t in _TOKENS.findall(text.lower()) if t not in _STOPPED]


def find_span(text: str, phrase: str) -> tuple[int, int] | None:
    """Where a phrase stands between word boundaries, whatever its case."""
    low, wanted = text.lower(), phrase.lower()
    if len(low) != len(text):  # a letter has grown: compare as it stands
        low, wanted = text, phrase
    at = low.find(wanted) if wanted else -1
    while at >= 0:
        end = at + len(wanted)
        if not (at and low[at - 1].isalnum()) and not (end < len(low) and low[end].isalnum()):
            return at, end
        at = low.find(wanted, at + 1)
    return None


def useful_anchor(text: str) -> bool:
    words = tokens_of(text)
    if not words or all(w in GENERIC_WORDS for w in words) or (len(words) == 1 and len(words[0]) < 8):
        return False
    return len(words) > 2 or not any(w in WEAK_WORDS for w in words)


@lru_cache(maxsize=1 << 12)
def tidy_phrases(phrases: tuple[str, ...]) -> tuple[str, ...]:
    """The phrases that may be anchors, up to the first bar, colon or dash, longest first."""
    tidy = [re.sub(r"[|:–].*$", "", p or "").strip() for p in phrases]
    return tuple(sorted((p for p in tidy if 4 <= len(p) <= 90), key=len, reverse=True))


def anchor_span(sentence: str, phrases: list[str], target_words: set[str] | frozenset[str]) -> tuple[int, int] | None:
    """The part of a sentence to link: the longest phrase of the target that it has, else the first run of two to four of
    its words that are all the target's."""
    for phrase in tidy_phrases(tuple(phrases)):
        span = find_span(sentence, phrase)
        if span and useful_anchor(sentence[slice(*span)]):
            return span
    words, tokens = _sentence_tokens(sentence)
    # Tokens of each word; none if one of them is not the target's. The tokens of a run are those of its words.
    own = [len(t) if target_words.issuperset(t) else None for t in tokens]
    for i in range(len(words)):
        for size in (4, 3, 2, 1) if own[i] is not None else ():
            run = own[i : i + size]
            if None not in run and sum(run) >= 2:
                span = find_span(sentence, " ".join(words[i : i + size]))
                if span and useful_anchor(sentence[slice(*span)]):
                    return span
    return None


@lru_cache(maxsize=1 << 16)
def _word_tokens(word: str) -> tuple[str, ...]:
    return tuple(tokens_of(word))


@lru_cache(maxsize=1 << 10)
def _sentence_tokens(sentence: str) -> tuple[list[str], list[tuple[str, ...]]]:
    words = _WORDS.findall(sentence)
    return words, [_word_tokens(w) for w in words]


@lru_cache(maxsize=1 << 12)
def _target_words(phrases: tuple[str, ...], key: str) -> frozenset[str]:
    return frozenset(w for p in (*phrases, key) for w in tokens_of(p))


def link_phrases(rows: DataFrame, key: str) -> Column:
    """The phrases of a page: its queries where they are known, headings, and the last part of its address."""
    slug = F.regexp_replace(F.element_at(F.split(F.rtrim(F.col(key), F.lit("/")), "/"), -1), "[-_]", " ")
    phrases = F.array("h1_text", "title", slug)
    if "top_queries" in rows.columns:
        phrases = F.concat(F.coalesce("top_queries", F.array().cast("array<string>")), phrases)
    return phrases


def anchored(rows: DataFrame) -> DataFrame:
    """Adds anchor, anchor_start and anchor_end (null: the sentence has none) for rows with sentence, target_key, title and
    h1_text, and top_queries where they are known."""
    phrases = link_phrases(rows, "target_key")

    @F.pandas_udf("struct<start:int,end:int>")
    def spans(sentence: pd.Series, wanted: pd.Series, key: pd.Series) -> pd.DataFrame:
        out = []
        for text, own, k in zip(sentence, wanted, key, strict=True):
            known = [p for p in own if p]
            out.append(anchor_span(text or "", known, _target_words(tuple(known), k or "")))
        return pd.DataFrame({"start": [None if x is None else x[0] for x in out], "end": [None if x is None else x[1] for x in out]}).astype("Int32")

    # Few bytes may be many pairs: adaptive execution would leave them to one task.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "target_key", "sentence").withColumn("_span", spans(F.col("sentence"), phrases, F.col("target_key")))
    text = F.substring("sentence", F.col("_span.start") + 1, F.col("_span.end") - F.col("_span.start"))
    return found.withColumns({"anchor": F.coalesce(text, F.lit("")), "anchor_start": F.col("_span.start"), "anchor_end": F.col("_span.end")}).drop("_span")


def source_authority(depth: Column, clicks: Column, inbound: Column) -> Column:
    return clamp(24 - depth * 3, 6, 24) + clamp(clicks / 15, 0, 12) + clamp(inbound, 0, 10)


def target_need(inbound: Column, impressions: Column, position: Column, sessions: Column) -> Column:
    return clamp((10 - inbound) * 4, 0, 36) + clamp(impressions / 80, 0, 26) + F.when(position.between(4, 20), 16).otherwise(0) + clamp(sessions / 25, 0, 12)


def semantic_boost(similarity: Column) -> Column:
    return F.when(similarity > 0, clamp((similarity - 0.42) * 58, 0, 24)).otherwise(0.0)


def scored(candidates: DataFrame) -> DataFrame:
    """``candidates``: target and source measures, overlap, similarity, anchor. Adds score, confidence, type; drops weak ones."""
    anchor = half_up(clamp(F.size(link_tokens(F.col("anchor"))) * 3 + F.when(F.length("anchor") >= 8, 3).otherwise(0), 4, 12))
    need = target_need(F.col("inbound"), F.col("impressions"), F.col("position"), F.col("sessions"))
    authority = source_authority(F.col("depth"), F.col("source_clicks"), F.col("source_inbound"))
    score = half_up(clamp(need + authority + F.col("overlap") * 8 + semantic_boost(F.col("similarity")) + anchor, 0, 100)).cast("int")
    kept = candidates.filter((F.col("overlap") >= 2) | (F.col("similarity") >= LEAST_SIMILARITY)).filter(F.col("anchor") != "")
    rows = kept.withColumn("score", score).filter(F.col("score") >= LEAST_SCORE)
    return rows.withColumns({"confidence": confidence_label(F.col("score")), "type": opportunity_type(F.col("inbound"), F.col("position"), F.col("sessions"), F.col("impressions"))})


def top_per_target(rows: DataFrame, k: int = 3) -> DataFrame:
    own = Window.partitionBy("site", "target_key").orderBy(F.desc("score"), "source_key", "anchor")
    return rows.withColumn("_rn", F.row_number().over(own)).filter(F.col("_rn") <= k).drop("_rn")
