"""Candidates by shared words, without a row for each word that two texts share.

Targets and sentences meet in blocks, each pair of blocks in one task: the words of a block of targets become an inverted
list, the words of a block of sentences are looked up in it, and equal pairs are counted. What is shuffled are the blocks, a
sentence once for each block of targets; a pair leaves its task only if it shares enough words. A word that all have is no
hot key, since no row is dealt by a word. Blocks, and the pairs that a task counts at once, have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import link_tokens

#: Rows of a block at most, shared words that a task counts at once, and pairs that it gives at once.
PACK, COUNTED, GIVEN = 4000, 1 << 22, 50_000


def _packed(rows: DataFrame, prefix: str, pack: int) -> DataFrame:
    """Blocks of ``rows``: of each column an array."""
    shape = ", ".join(f"{prefix}{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, pack):
                part = batch.slice(at, pack)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in part.columns], names=[prefix + n for n in part.schema.names])

    return rows.mapInArrow(run, shape)


def inverted(words: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a block, and of each the rows that have it: all of them in order, and where each word's begin."""
    tokens = words.flatten()
    known = pc.unique(tokens)
    word = pc.index_in(tokens, value_set=known).to_numpy(zero_copy_only=False)
    order = np.argsort(word, kind="stable")
    holders = pc.list_parent_indices(words).to_numpy()[order].astype(np.int64)
    return known, holders, np.searchsorted(word[order], np.arange(len(known) + 1))


def shared_in(starts: np.ndarray, holders: np.ndarray, n: int, words: np.ndarray, lengths: np.ndarray, least: int, counted: int = COUNTED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(target, sentence, overlap) by their places in two blocks, for all that share ``least`` words or more. ``n`` targets
    by ``inverted``; the sentences' words by their places there, -1 for others, and how many each has."""
    own = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)[words >= 0]
    asked = words[words >= 0]
    times = starts[asked + 1] - starts[asked]
    upto = np.append(0, np.cumsum(times))
    whole = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))  # where sentences begin
    at = 0
    while at < len(whole) - 1:
        # As many sentences as may be counted at once, or one.
        stop = max(at + 1, int(np.searchsorted(upto[whole], upto[whole[at]] + counted, side="right")) - 1)
        a, b = whole[at], whole[stop]
        run = times[a:b]
        place = np.repeat(starts[asked[a:b]] - (upto[a:b] - upto[a]), run) + np.arange(upto[b] - upto[a])
        pair = np.repeat(own[a:b], run) * n + holders[place]
        pair.sort()
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        overlap = np.diff(np.append(first, len(pair)))
        kept = overlap >= least
        pair = pair[first[kept]]
        yield pair % n, pair // n, overlap[kept]
        at = stop


def _shared(t_words: pa.ListArray, s_words: pa.ListArray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    known, holders, starts = inverted(t_words)
    words = pc.fill_null(pc.index_in(s_words.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
    return shared_in(starts, holders, len(t_words), words, pc.fill_null(pc.list_value_length(s_words), 0).to_numpy(), least)


def meetings(targets: DataFrame, sentences: DataFrame, least: int = 2, pack: int = PACK) -> tuple[DataFrame]:
    """All pairs that share ``least`` words, on different pages, in one frame: each pair once, so it is the ``first``."""
    t = targets.select("target_key", F.array_distinct(link_tokens(F.col("text"))).alias("words"))
    s = sentences.select("source_key", "sentence_id", F.array_distinct(link_tokens(F.col("sentence"))).alias("words"))
    enough = F.size("words") >= max(least, 1)
    n = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _packed(t.filter(enough), "t_", PACK).repartition(1 + n // 16).join(_packed(s.filter(enough), "s_", max(pack, 1)).repartition(n))
    names = ["t_target_key", "t_words", "s_source_key", "s_sentence_id", "s_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                target, t_words, source, sentence, s_words = (batch.column(c)[row].values for c in names)
                for ti, si, overlap in _shared(t_words, s_words, max(least, 1)):
                    for at in range(0, len(ti), GIVEN):
                        i, j = pa.array(ti[at : at + GIVEN]), pa.array(si[at : at + GIVEN])
                        columns = [target.take(i), source.take(j), sentence.take(j), pa.array(overlap[at : at + GIVEN].astype(np.int32))]
                        found = pa.RecordBatch.from_arrays(columns, names=["target_key", "source_key", "sentence_id", "overlap"])
                        yield found.filter(pc.not_equal(found.column(0), found.column(1)))

    kind = {f.name: f.dataType.simpleString() for f in (*t.schema, *s.schema)}
    shape = ", ".join(f"{c} {kind[c]}" for c in ("target_key", "source_key", "sentence_id"))
    return (blocks.mapInArrow(run, f"{shape}, overlap int").withColumn("first", F.lit(True)),)


def word_candidates(targets: DataFrame, sentences: DataFrame, existing: DataFrame, least: int = 2, pack: int = PACK) -> DataFrame:
    """(target_key, source_key, sentence_id, overlap): sentences that share ``least`` words or more with a target, on other
    pages that do not link there yet. No pair is lost."""
    (found,) = meetings(targets, sentences, least, pack)
    there = existing.select(F.col("from_key").alias("source_key"), F.col("to_key").alias("target_key")).distinct()
    return found.join(there, ["source_key", "target_key"], "left_anti").select("target_key", "source_key", "sentence_id", "overlap")
