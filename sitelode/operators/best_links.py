"""The best links to each target, without a row for each pair of a target and a sentence.

Targets and sentences meet in blocks, as in ``words_met``. A task takes some of the targets and a large part of the sentences,
and holds the best ``k`` links to each of its targets from each site; only these leave it, so that what is written grows with
the targets and not with the pairs. The result equals that of scoring all pairs and then taking the first:

* A pair's score is known up to that of its anchor, at most MOST_ANCHOR. Where even that would come behind the ``k`` links
  found so far, the anchor is not looked for.
* An anchor has two words of the target with nothing but spaces between, or the first two of a phrase, or is a phrase of one
  word. Pairs without any have no anchor, which is told for all pairs at once by the codes of their words.
* All others are tried by ``anchor_span`` itself, best first, until no pair that is left can come before the ``k`` found.

A block of sentences has all sentences of its pages, so that a task knows which near pages share no words with a target: of
these, the first sentence is tried.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import link_tokens
from ..shared import settings, stored
from .links import LEAST_SCORE, _target_words, _word_tokens, _WORDS, anchor_span, likeness, link_phrases, semantic_boost, tidy_phrases, tokens_of
from .words_met import inverted, shared_in

TOP, MOST_ANCHOR, MOST_SCORE = 3, 12, 100
#: Targets and sentences of a block at most (one page's sentences stay together), sentences that a task reads, shared words
#: that it counts at once, and words of pairs that it looks up at once.
TARGETS, SENTENCES, PART, COUNTED, LOOKED_UP = 1000, 16_000, 500_000, 1 << 20, 1 << 19
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MEMBER, FIRST, ALONE = 1, 2, 4
_GAP = re.compile(r"(?:[^\W_]|[- ])*")
FOUND = "site string, target_key string, source_key string, anchor string, overlap int, similarity double, score int"


def best_links(pages: DataFrame, targets: DataFrame, sentences: DataFrame, existing: DataFrame, near: DataFrame, k: int = TOP, part: int = PART) -> DataFrame:
    """FOUND: the ``k`` best links to each target from each site, by score, source, anchor and overlap.

    ``pages``: page_key, url, canonical_url, title, h1_text, site, need (as a target) and authority (as a source), and
    top_queries where they are known; ``targets``: target_key, text; ``sentences``: source_key, sentence_id, sentence;
    ``existing``: from_key, to_key; ``near``: target_key, source_key, similarity, a pair once."""
    spark = targets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = pages.select("page_key", "site", "need", "authority", link_phrases(pages, "page_key").alias("phrases"), *likeness())
    close = near.groupBy("target_key").agg(F.collect_list(F.struct("source_key", "similarity", semantic_boost(F.col("similarity")).alias("boost"))).alias("near"))
    asked = targets.select(F.col("target_key").alias("page_key"), F.array_distinct(link_tokens(F.col("text"))).alias("words")).join(own, "page_key")
    asked = asked.join(close.withColumnRenamed("target_key", "page_key"), "page_key", "left")
    told = sentences.groupBy(F.col("source_key").alias("page_key")).agg(F.array_sort(F.collect_list(F.struct("sentence_id", "sentence"))).alias("s"))
    there = existing.join(targets.select(F.col("target_key").alias("to_key")), "to_key", "left_semi")
    there = there.groupBy(F.col("from_key").alias("page_key")).agg(F.collect_set("to_key").alias("there"))
    sources = told.join(own.select("page_key", "site", "authority", "_slug", "_home", "_heading"), "page_key").join(there, "page_key", "left")
    # By ranges of keys: the first pages of a part then settle many targets, of which the rest of it is not looked at.
    sources = sources.repartitionByRange(n, "page_key").withColumns({"words": F.transform("s", lambda x: F.array_distinct(link_tokens(x["sentence"]))), "s": F.col("s.sentence")})
    # Blocks hold a stated number of sentences, so their count tells how many parts to make.
    with settings(spark, {ROWS: "500"}):
        packs = stored(sources.mapInArrow(_packed(_source_block, "s", SENTENCES), "key string, block binary"), "sentences")
    parts = max(1 + n // 32, -(-packs.count() * SENTENCES // part))
    # Written before the meeting, whose batches of few rows are not meant for what leads to the targets.
    left = stored(asked.repartition(n, "page_key").mapInArrow(_packed(_target_block, None, TARGETS), "t_key string, t_block binary"), "targets")
    both = left.repartition(n).hint("shuffle_replicate_nl").join(packs.coalesce(parts).sortWithinPartitions("key"))
    with settings(spark, {ROWS: "4"}):  # of blocks, two at once
        best = stored(both.mapInArrow(_best(k), FOUND), "best")
    place = F.row_number().over(Window.partitionBy("site", "target_key").orderBy(F.desc("score"), "source_key", "anchor", F.desc("overlap"), F.desc("similarity")))
    return best.withColumn("_rn", place).filter(F.col("_rn") <= k).drop("_rn")


# -- blocks -----------------------------------------------------------------------------------------------------------------


def _packed(block, counted: str | None, most: int):  # noqa: ANN001, ANN202
    """Rows by key, in blocks of ``most`` rows or, with ``counted``, of so many entries of that column, or one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            size = pc.fill_null(pc.list_value_length(batch[counted]), 0).to_numpy() if counted else np.ones(batch.num_rows, int)
            upto, at = np.cumsum(size), 0
            while at < batch.num_rows:
                before = int(upto[at - 1]) if at else 0
                stop = max(at + (not held), int(np.searchsorted(upto, before + most - n, side="right")))
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    n += int(upto[stop - 1]) - before
                if stop < batch.num_rows:
                    yield _sealed(held, block)
                    held, n = [], 0
                at = stop
        if held:
            yield _sealed(held, block)

    def _sealed(held: list[pa.Table], block) -> pa.RecordBatch:  # noqa: ANN001
        rows = pa.concat_tables(held).combine_chunks()
        rows = rows.take(pc.sort_indices(rows["page_key"])).combine_chunks()
        parts = block({c: _one(rows[c]) for c in rows.column_names})
        whole = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in parts.values()], names=list(parts))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(whole)
        names = ("key", "block") if counted else ("t_key", "t_block")
        return pa.RecordBatch.from_arrays([pa.array([rows["page_key"][0].as_py()], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=list(names))

    return run


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _opened(data: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return {n: c.values.slice(0, len(c.values)) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _lists(a: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The lengths and the values of lists, of which none counts as empty."""
    return pc.fill_null(pc.list_value_length(a), 0).cast(pa.int32()), a.flatten()


def _target_block(c: dict[str, pa.Array]) -> dict[str, pa.Array]:
    (n_words, words), (n_near, near), (n_phrases, phrases) = _lists(c["words"]), _lists(c["near"]), _lists(c["phrases"])
    return {"key": c["page_key"], "need": c["need"], "slug": c["_slug"], "home": c["_home"], "heading": c["_heading"], "n_words": n_words, "words": words, "n_phrases": n_phrases, "phrases": phrases, "n_near": n_near, "near_key": near.field("source_key"), "near_similarity": near.field("similarity"), "near_boost": near.field("boost")}


def _source_block(c: dict[str, pa.Array]) -> dict[str, pa.Array]:
    """Words by their places in one vocabulary: those that count for the overlap, and each sentence's words in order, of which
    ``joined`` tells whether the next one follows behind spaces, letters and hyphens only."""
    (n_sentences, sentences), (_, lists), (n_there, there) = _lists(c["s"]), _lists(c["words"]), _lists(c["there"])
    n_words, words = _lists(lists)
    runs, joined, n_run, odd = [], [], [], []
    for text in sentences.to_pylist():
        run, near = sentence_words(text or "")
        runs += run
        joined += near
        n_run.append(len(run))
        odd.append(is_odd(text or ""))
    every = pa.concat_arrays([words.cast(pa.string()), pa.array(runs, pa.string())]).dictionary_encode()
    return {"key": c["page_key"], "site": c["site"], "authority": c["authority"], "slug": c["_slug"], "home": c["_home"], "heading": c["_heading"], "n_sentences": n_sentences, "sentence": sentences, "odd": pa.array(odd, pa.bool_()), "n_there": n_there, "there": there, "vocabulary": every.dictionary, "n_words": n_words, "words": every.indices.slice(0, len(words)), "n_run": pa.array(n_run, pa.int32()), "run": every.indices.slice(len(words)), "joined": pa.array(joined, pa.bool_())}


def sentence_words(text: str) -> tuple[list[str], list[bool]]:
    """The tokens of a sentence's words in order, and whether each is joined with the next one."""
    run: list[str] = []
    joined: list[bool] = []
    end = None
    for m in _WORDS.finditer(text):
        own = _word_tokens(m.group())
        if own:
            if end is not None:
                joined[-1] = m.start() - end == 1 and text[end] == " " or bool(_GAP.fullmatch(text, end, m.start()))
            run += own
            joined += [True] * len(own)
            end = m.end()
    if joined:
        joined[-1] = False
    return run, joined


def is_odd(text: str) -> bool:
    """Whether lower case of a part may differ from that part of lower case; such texts are tried without a look at words."""
    return not text.isascii() and (len(text.lower()) != len(text) or "Σ" in text)


# -- meeting ----------------------------------------------------------------------------------------------------------------


class _Targets:
    """A block of targets and the best links to each, by site."""

    def __init__(self, data: bytes) -> None:
        a = _opened(data)
        self.keys, self.n = a["key"], len(a["key"])
        self.key = a["key"].to_pylist()
        self.need = a["need"].to_numpy(zero_copy_only=False)
        self.slug, self.home, self.heading = (a[c].to_pylist() for c in ("slug", "home", "heading"))
        self.known, self.holders, self.starts = inverted(pa.ListArray.from_arrays(_ends(a["n_words"]), a["words"]))
        self.words = _cut(a["n_words"], a["words"].to_pylist())
        self.phrases = [tuple(p for p in own if p) for own in _cut(a["n_phrases"], a["phrases"].to_pylist())]
        self.own = [_target_words(p, k or "") for p, k in zip(self.phrases, self.key, strict=True)]
        self.near_key, self.near_of = a["near_key"], np.repeat(np.arange(self.n), a["n_near"].to_numpy())
        self.similarity, self.boost = (a[c].to_numpy(zero_copy_only=False) for c in ("near_similarity", "near_boost"))
        # What each of the targets' words is to each of them; the last column is that of any other word.
        place: dict[str, int] = {}
        marks = []
        odd = np.zeros(self.n, bool)
        for t, (own, phrases) in enumerate(zip(self.own, self.phrases, strict=True)):
            marks += [(t, place.setdefault(w, len(place)), MEMBER) for w in own]
            for p in tidy_phrases(phrases):
                odd[t] |= is_odd(p)
                if tokens := tokens_of(p):
                    marks.append((t, place.setdefault(tokens[0], len(place)), FIRST if len(tokens) > 1 else ALONE))
        self.tokens, self.odd = pa.array(list(place), pa.string()), odd
        self.role = np.zeros((self.n, len(place) + 1), np.uint8)
        for t, w, role in marks:
            self.role[t, w] |= role
        self.best: dict[tuple[int, str], list[tuple]] = {}
        self.bar: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # by site: the k-th score and source of each target

    def add(self, t: int, site: str, row: tuple, k: int) -> None:
        held = self.best.setdefault((t, site), [])
        insort(held, row)
        if len(held) >= k:
            del held[k:]
            if site not in self.bar:
                self.bar[site] = (np.full(self.n, LEAST_SCORE, np.int64), np.full(self.n, None, object))
            score, source = self.bar[site]
            score[t], source[t] = -held[-1][0], held[-1][1]


class _Sources:
    """A block of pages and their sentences."""

    def __init__(self, data: bytes) -> None:
        a = _opened(data)
        self.keys, self.key = a["key"], np.array(a["key"].to_pylist(), object)
        self.authority = a["authority"].to_numpy(zero_copy_only=False)
        self.sites, self.site = np.unique(np.array([s or "" for s in a["site"].to_pylist()], object), return_inverse=True)
        self.slug, self.home, self.heading = (a[c].to_pylist() for c in ("slug", "home", "heading"))
        n = a["n_sentences"].to_numpy()
        self.first, self.count, self.page = np.cumsum(n) - n, n, np.repeat(np.arange(len(n)), n)
        self.sentence, self.odd = a["sentence"], a["odd"].to_numpy(zero_copy_only=False)
        self.there, self.there_of = a["there"], np.repeat(np.arange(len(n)), a["n_there"].to_numpy())
        self.vocabulary = a["vocabulary"]
        self.words, self.n_words = a["words"].to_numpy(), a["n_words"].to_numpy()
        self.run, self.n_run, self.joined = a["run"].to_numpy(), a["n_run"].to_numpy(), a["joined"].to_numpy(zero_copy_only=False)


def _ends(lengths: pa.Array) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(lengths.to_numpy())), pa.int32())


def _cut(lengths: pa.Array, values: list) -> list[list]:
    ends = np.append(0, np.cumsum(lengths.to_numpy())).tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _places(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each of ``words`` is in ``known``; -1 if it isn't."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _best(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block of targets meets all its blocks of sentences before the next one comes; if it came again, its best would
        # be more rows than needed.
        key, held = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                now = batch.column(0)[row].as_py()
                if held is None or now != key:
                    if held is not None:
                        yield from _rows(held)
                    key, held = now, _Targets(batch.column(1)[row].as_py())
                _meet(held, _Sources(batch.column(3)[row].as_py()), k)
        if held is not None:
            yield from _rows(held)

    return run


def _rows(t: _Targets) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32())
    names = [f.split()[0] for f in FOUND.split(", ")]
    rows = [(site, t.key[i], source, anchor, -overlap, -similarity, -score) for (i, site), own in t.best.items() for score, source, anchor, overlap, similarity in own]
    for at in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[at : at + 50_000], strict=True), kinds, strict=True)], names=names)


def _meet(t: _Targets, s: _Sources, k: int) -> None:
    n, n_pages = t.n, len(s.keys)
    # Pairs that are none: a page with itself, and links that are there.
    itself, linked = _places(s.keys, t.keys), _places(s.there, t.keys)
    barred = np.unique(np.concatenate([np.flatnonzero(itself >= 0) * n + itself[itself >= 0], s.there_of[linked >= 0] * n + linked[linked >= 0]]))
    # Near pairs of these blocks.
    where = _places(t.near_key, s.keys)
    near = where[where >= 0] * n + t.near_of[where >= 0]
    order = np.argsort(near, kind="stable")
    near, similarity, boost = near[order], t.similarity[where >= 0][order], t.boost[where >= 0][order]
    bar, last = _bars(t, s)
    open_ = ~_among(near, barred)[0]
    near, similarity, boost = near[open_], similarity[open_], boost[open_]
    met = np.zeros(len(near), bool)
    near_page, near_target = np.zeros(n_pages, bool), np.zeros(n, bool)
    near_page[near // n], near_target[near % n] = True, True
    # Targets that no page of this block can get are left out, and most other pairs by what needs no look at near ones.
    left = ((bar < MOST_SCORE) | (last >= 0)).any(axis=0)
    kept = left[t.holders]
    starts, holders = np.append(0, np.cumsum(kept))[t.starts], t.holders[kept]
    least = (bar - t.need - (MOST_ANCHOR + 0.5 + 1e-6)).ravel()
    upto = np.where(bar < MOST_SCORE, n_pages, last).ravel()
    words = _places(s.vocabulary, t.known)[s.words]
    looks = None
    for ti, si, overlap in shared_in(starts, holders, n, words, s.n_words, 2, COUNTED):
        page = s.page[si]
        of = s.site[page] * n + ti
        kept = (s.authority[page] + overlap * 8 >= least[of]) & (page <= upto[of])
        if len(near):
            kept |= near_page[page] & near_target[ti]
        kept = np.flatnonzero(kept)
        ti, si, page, overlap = ti[kept], si[kept], page[kept], overlap[kept]
        pair = page * n + ti
        is_near, at = _among(pair, near)
        met[at[is_near]] = True
        alike, extra = np.zeros(len(pair)), np.zeros(len(pair))
        alike[is_near], extra[is_near] = similarity[at[is_near]], boost[at[is_near]]
        base = t.need[ti] + s.authority[page] + overlap * 8 + extra
        most = _score(base, MOST_ANCHOR)
        of = s.site[page], ti
        kept = np.flatnonzero((most > bar[of]) | ((most == bar[of]) & (page <= last[of])))
        kept = kept[~_among(pair[kept], barred)[0]]
        looks = looks or _Looks(t, s)
        kept = kept[looks.may_have(ti[kept], si[kept])]
        _try(t, s, k, *(a[kept] for a in (ti, si, page, overlap, alike, base, most)))
    # Near pages whose sentences all share less than two words: the first one.
    alone = np.flatnonzero(~met & left[near % n])
    page, ti = near[alone] // n, near[alone] % n
    if len(alone):
        bounds = np.append(0, np.cumsum(s.n_words))
        own = lambda f: s.vocabulary.take(pa.array(s.words[bounds[f] : bounds[f + 1]])).to_pylist()
        overlap = np.array([len(set(t.words[i]).intersection(own(f))) for i, f in zip(ti, s.first[page], strict=True)], np.int64)
        base = t.need[ti] + s.authority[page] + overlap * 8 + boost[alone]
        _try(t, s, k, ti, s.first[page], page, overlap, similarity[alone], base, _score(base, MOST_ANCHOR))


def _among(asked: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``asked`` is in the sorted ``known``, and where."""
    if not len(known):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return known[at] == asked, at


def _score(base, anchor):  # noqa: ANN001, ANN202
    return np.floor(np.clip(base + anchor, 0, MOST_SCORE) + 0.5).astype(np.int64)


def _bars(t: _Targets, s: _Sources) -> tuple[np.ndarray, np.ndarray]:
    """By site of ``s`` and target: the score that a link must have to come among the ``k`` best, and the last page that may
    come among them with just this score."""
    bar, last = np.full((len(s.sites), t.n), LEAST_SCORE), np.full((len(s.sites), t.n), len(s.key))
    for i, site in enumerate(s.sites):
        if site in t.bar:
            score, source = t.bar[site]
            full = np.flatnonzero(source != None)  # noqa: E711
            bar[i], last[i, full] = score, np.searchsorted(s.key, source[full], side="right") - 1
    return bar, last


class _Looks:
    """Tells by the places of words which pairs may have an anchor."""

    def __init__(self, t: _Targets, s: _Sources) -> None:
        self.t, self.s = t, s
        word = _places(s.vocabulary, t.tokens)[s.run]
        after = np.append(word, -1)[1:]
        after[np.cumsum(s.n_run)[s.n_run > 0] - 1] = -1  # the last of a sentence
        alone = (t.role & ALONE).any(axis=0)
        kept = (word >= 0) & ((after >= 0) | alone[word])
        self.word, self.after, self.joined = word[kept], after[kept], s.joined[kept]
        self.count = np.bincount(np.repeat(np.arange(len(s.n_run)), s.n_run)[kept], minlength=len(s.n_run))
        self.start = np.cumsum(self.count) - self.count

    def may_have(self, ti: np.ndarray, si: np.ndarray) -> np.ndarray:
        found = self.t.odd[ti] | self.s.odd[si]
        upto, at = np.cumsum(self.count[si]), 0
        while at < len(si):
            before = int(upto[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, before + LOOKED_UP, side="right")))
            n = self.count[si[at:stop]]
            pair = np.repeat(np.arange(at, stop), n)
            place = np.repeat(self.start[si[at:stop]] - (upto[at:stop] - n - before), n) + np.arange(len(pair))
            one, two = self.t.role[ti[pair], self.word[place]], self.t.role[ti[pair], self.after[place]]
            good = (one & ALONE > 0) | ((one & two & MEMBER > 0) & (self.joined[place] | (one & FIRST > 0)))
            found[pair[good]] = True
            at = stop
        return found


def _try(t: _Targets, s: _Sources, k: int, ti, si, page, overlap, alike, base, most) -> None:  # noqa: ANN001
    """Looks for the anchors of pairs, best first, and stops at each target and site where no more can come before its last."""
    if not len(ti):
        return
    site = s.site[page]
    order = np.lexsort((page, -most, site, ti))
    group = ti[order] * len(s.sites) + site[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(group)), strict=True):
        target, name = int(ti[order[a]]), s.sites[site[order[a]]]
        held = t.best.get((target, name), ())
        for at in order[a:b].tolist():
            p, high = int(page[at]), int(most[at])
            source = s.key[p]
            if high < LEAST_SCORE or (len(held) >= k and (-high, source) > held[-1][:2]):
                break
            if _one_page(t, target, s, p):
                continue
            text = s.sentence[int(si[at])].as_py() or ""
            span = anchor_span(text, t.phrases[target], t.own[target])
            if span is None:
                continue
            anchor = text[slice(*span)]
            score = int(_score(base[at], _anchor_score(anchor)))
            if anchor and score >= LEAST_SCORE:
                t.add(target, name, (-score, source, anchor, -int(overlap[at]), -float(alike[at])), k)
                held = t.best[(target, name)]


@lru_cache(maxsize=1 << 14)
def _anchor_score(anchor: str) -> float:
    return float(min(12, max(4, len(tokens_of(anchor)) * 3 + (3 if len(anchor) >= 8 else 0))))


def _one_page(t: _Targets, i: int, s: _Sources, p: int) -> bool:
    """Whether both pages are nearly one, as ``apart`` has it."""
    return bool((t.slug[i] and t.slug[i] == s.slug[p]) or (t.home[i] and t.home[i] == s.home[p]) or (t.heading[i] and len(s.heading[p] or "") >= 24 and t.heading[i] == s.heading[p]))
