"""Removal of repeated passages by a common-prefix-aware distributed merge sort of text suffixes.

A byte goes if some string of ``length`` bytes that covers it also starts in a row with a smaller id. So each position of a
text stands for its suffix, cut off at ``length`` bytes, and what is needed of each suffix is whether a row with a smaller
id has it too.

1. Texts are read once into compressed blocks of about BLOCK bytes, a table bucketed by block; blocks never move.
2. Which suffixes can repeat at all? The strings of ``length`` bytes that share their least hashed 24-byte gram (leftmost at
   ties) follow one another; they make one *stretch*, about one for every fourteen bytes. Equal strings have equal grams at
   equal places, so a string can only be in two rows if its gram is. Blocks send fingerprints of their grams, hash buckets
   answer with one bit for each: held by more than one row, or not. False alarms cost work, not results.
3. A stretch that several rows have goes into the sort as one suffix, since who has all of it can lose all of it. Where a
   gram has several stretches (at the ends of shared passages), their parts may still repeat, so the strings of a stretch
   go in too, but only from the rows of the least id that has this stretch: all others lose the whole of it anyway. Where a
   gram has one stretch only, its strings are in the same rows as the stretch. A second exchange, of grams with a 64-bit
   hash of their stretches and the least id of each, tells which; a third one, of fingerprints of those strings, leaves out
   what is in one row only.
4. Each block sorts what is left into runs of at most RUN suffixes, each once with the least id of its rows. A run is cut at
   splitters, which come from regular samples of the candidates of all blocks, and its parts travel front-coded: the length
   of the prefix shared with the suffix before, then only the rest.
5. A range merges its runs by loser trees that keep, at every node, the length of the prefix shared with the last winner:
   where two lengths differ, their order is known without a look at the texts; where they agree, comparing begins behind
   them. A range is cut into sub-ranges of about SUBRANGE suffixes whose trees run side by side in numpy. A winner that
   shares all its bytes with the last one is the same suffix. The answer is one bit for each suffix of each run: another run
   has it from a smaller id.
6. Blocks mark the strings so found, or found inside the block, and give what is left.

A passage that every row has is one suffix in each run, so nothing is hot; a task holds a block, a bucket or a range. Runs
in a range beyond TREE are first put together by sorting. Sizes of buckets and ranges are parameters; the number of both
grows with the input, and a block sends a bucket nothing where it has nothing.

A null text is empty. Only rows with an id take part: a row without one keeps everything and causes nothing. Rows with equal
ids remove nothing from each other, nor does a row from itself. Texts shorter than ``length`` are kept. An empty table gives
no rows. Only the id and text columns are read, so other columns may have any names. Cuts are between bytes, so what is kept
is binary. Two different stretches of one gram are told apart by a hash of 64 bits.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, shared_path
from .katz import expand, squeeze
from .words import as_bytes, distinct, mix, slices

LENGTH = 50
GRAM = 24
BLOCK = 8 << 20
#: Bytes of text whose grams are hashed at once.
SLICE = 1 << 17
#: Suffixes of a run.
RUN = 1 << 18
#: Grams that a bucket answers for, and suffixes that a range merges, on average.
BUCKET, RANGE = 1 << 19, 1 << 18
#: Suffixes of a sub-range, and most runs that a tree merges.
SUBRANGE, TREE = 48, 64
#: Strings that the driver draws for each range, and stretches of a block that one sample stands for.
SAMPLES, EVERY = 8, 128

_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_POWERS = np.array([1 << 8 * k for k in range(1, 8)], np.uint64)
_TURN = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(0xFFFFFFFF00000000)


# -- stretches ------------------------------------------------------------------------------------------------------------


@dataclass
class Stretches:
    """``text`` has spare bytes behind it; a stretch begins at ``first`` and its last string at ``last``."""

    text: np.ndarray
    length: int
    row: np.ndarray  # number of the text in its block
    key: np.ndarray  # hash of the gram
    first: np.ndarray
    last: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return self.last - self.first + self.length

    def subset(self, which: np.ndarray) -> Stretches:
        return Stretches(self.text, self.length, self.row[which], self.key[which], self.first[which], self.last[which])


def stretches(text: bytes, sizes: np.ndarray, takes_part: np.ndarray, length: int = LENGTH) -> Stretches:
    """Of the texts that follow one another in ``text``."""
    whole = np.frombuffer(text + bytes(8 * words_of(length) + GRAM), np.uint8)
    ends = np.cumsum(sizes)
    found, at = [], 0
    while at < len(sizes):
        start = int(ends[at] - sizes[at])
        to = max(int(np.searchsorted(ends, start + SLICE, "right")), at + 1)
        row, key, first, last = _slice(whole[start : int(ends[to - 1]) + GRAM], sizes[at:to], takes_part[at:to], length)
        found.append((row + at, key, first + start, last + start))
        at = to
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)]
    return Stretches(whole, length, *columns)


def _slice(text: np.ndarray, sizes: np.ndarray, takes_part: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    nothing = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(text) - GRAM
    if n < length:
        return nothing
    eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    m = n - GRAM + 1
    hashes = mix(eight[:m] * _TURN ^ eight[8 : m + 8] * np.uint64(0xC2B2AE3D27D4EB4F) ^ eight[16 : m + 16] * np.uint64(0x165667B19E3779F9))
    value, reach, wide = (hashes & _HIGH) | np.arange(m, dtype=np.uint64), 1, length - GRAM + 1
    while reach < wide:  # half a hash and the place of the least of the next ``reach`` grams
        step = min(reach, wide - reach)
        value = np.minimum(value[:-step], value[step:])
        reach += step
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    starts = np.flatnonzero((row[: n - length + 1] == row[length - 1 :]) & takes_part[row[: n - length + 1]])
    if not len(starts):
        return nothing
    least = (value[starts] & ~_HIGH).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[starts[1:]] != row[starts[:-1]])
    begin = np.flatnonzero(new)
    return row[starts[begin]].astype(np.int64), hashes[least[begin]], starts[begin], starts[np.append(begin[1:], len(starts)) - 1]


# -- suffixes as words ----------------------------------------------------------------------------------------------------


def words_of(length: int) -> int:
    """Words of eight bytes that hold the longest stretch and one byte for its size."""
    return (2 * length - GRAM) // 8 + 1


def read_words(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wide: int) -> np.ndarray:
    """One row for each string, whose big-endian words compare as its bytes do; behind them zeros and, last, the size."""
    eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    out = np.empty((len(starts), wide), np.uint64)
    for k in range(wide):
        left = np.clip(sizes - 8 * k, 0, 8)
        out[:, k] = (eight[np.where(left > 0, starts + 8 * k, 0)] & _KEEP[left]).byteswap()
    out[:, -1] |= sizes.astype(np.uint64)
    return out


def order_of(words: np.ndarray) -> np.ndarray:
    """The sorted order, word by word: only what ties in one word is compared in the next."""
    order = np.argsort(words[:, 0])
    group = np.zeros(len(order), np.int64)
    at = np.arange(len(order))
    for k in range(words.shape[1]):
        value = words[order[at], k]
        if k:
            inner = np.lexsort((value, group))
            order[at] = order[at[inner]]
            value = value[inner]
        new = np.ones(len(at), bool)
        new[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        tied = ~new
        tied[:-1] |= tied[1:]
        at, group = at[tied], group[tied]
        if not len(at):
            break
    return order


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that rows of words share from the beginning on; all of them where they are equal."""
    differ = a ^ b
    column = np.argmax(differ != 0, axis=1)
    value = differ[np.arange(len(a)), column]
    return np.where(value == 0, 8 * a.shape[1], 8 * column + 7 - np.searchsorted(_POWERS, value, "right"))


def hash_words(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        out = mix(out * _TURN + words[:, k])
    return out


def string_hashes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of each string of ``length`` bytes, by overlapping words."""
    eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    out = np.zeros(len(starts), np.uint64)
    for at in [*range(0, length - 8, 8), length - 8]:
        out = (out ^ eight[starts + at]) * _TURN
        out ^= out >> np.uint64(29)
    return mix(out)


def front_code(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(bytes shared with the suffix before, sizes, the other bytes in a row) of sorted suffixes; the other bytes begin with
    the first word of eight that is not wholly shared."""
    sizes = (words[:, -1] & np.uint64(255)).astype(np.int64)
    common = np.zeros(len(words), np.int64)
    common[1:] = shared(words[1:], words[:-1])
    column = np.arange(words.shape[1])
    text = words.copy()
    text[:, -1] &= ~np.uint64(255)
    rest = text[(column >= (common >> 3)[:, None]) & (column < ((sizes + 7) >> 3)[:, None])]
    return common.astype(np.uint8), sizes.astype(np.uint8), rest.tobytes()


def front_decode(common: np.ndarray, sizes: np.ndarray, rest: bytes, wide: int) -> np.ndarray:
    """The words of front-coded suffixes: a word is that of the last row that brought one at its place."""
    skipped, stop = common >> 3, (sizes.astype(np.int64) + 7) >> 3
    own = np.maximum(stop - skipped, 0)
    begin = np.cumsum(own) - own - skipped
    flat, rows = np.append(np.frombuffer(rest, np.uint64), np.uint64(0)), np.arange(len(common))
    out = np.zeros((len(common), wide), np.uint64)
    for c in range(wide):
        source = np.maximum.accumulate(np.where(skipped <= c, rows, 0))
        out[:, c] = flat[np.where(stop[source] > c, begin[source] + c, -1)]
    out[:, -1] |= sizes
    return out


# -- merging --------------------------------------------------------------------------------------------------------------


def merge_runs(words: np.ndarray, common: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in sorted order, bytes that each shares with the one before it) of sorted runs without repeats.

    Run k has the rows from ``starts[k]`` to ``starts[k + 1]``; ``common`` has the bytes shared with the row before."""
    if len(starts) - 1 > TREE:
        words, common, starts, back = _fewer_runs(words, starts)
        order, met = merge_runs(words, common, starts)
        return back[order], met
    begin, end = _subranges(words, starts)
    whole = 8 * words.shape[1]
    trees, leaves = begin.shape
    size = 1 << max(1, (leaves - 1).bit_length())
    pos = np.zeros((trees, size), np.int64)
    stop = np.zeros((trees, size), np.int64)
    pos[:, :leaves], stop[:, :leaves] = begin, end

    def play(a: np.ndarray, ha: np.ndarray, ia: np.ndarray, b: np.ndarray, hb: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, ...]:
        """Leaves a and b with items and shared lengths: (winner, its length, its item, loser, its length, its item)."""
        first, lost = ha > hb, np.minimum(ha, hb)
        even = np.flatnonzero((ha == hb) & (ha >= 0))
        if len(even):
            first[even], lost[even] = _less(words, ia[even], ib[even], ha[even], whole)
        return np.where(first, a, b), np.maximum(ha, hb), np.where(first, ia, ib), np.where(first, b, a), lost, np.where(first, ib, ia)

    # the first round of all trees, level by level
    leaf = np.broadcast_to(np.arange(size), (trees, size))
    item, height = pos.copy(), np.where(pos < stop, 0, -1)
    nodes = [np.zeros((trees, size), np.int64) for _ in range(3)]  # loser, its shared length, its item
    at = size
    while at > 1:
        w, hw, iw, lo, hl, il = (x.reshape(trees, at // 2) for x in play(*(y[:, side::2].ravel() for side in (0, 1) for y in (leaf, height, item))))
        for node, value in zip(nodes, (lo, hl, il), strict=True):
            node[:, at // 2 : at] = value
        leaf, height, item, at = w, hw, iw, at // 2
    leaf, height, item = leaf[:, 0], height[:, 0], item[:, 0]
    live = np.arange(trees)
    out, met, tree = [], [], []
    while True:
        going = height >= 0
        if not going.all():
            live, leaf, height, item = live[going], leaf[going], height[going], item[going]
        if not len(live):
            break
        out.append(item)
        met.append(height)
        tree.append(live)
        pos[live, leaf] += 1
        item = pos[live, leaf]
        more = item < stop[live, leaf]
        height = np.where(more, common[np.where(more, item, 0)], -1)
        node = (leaf + size) >> 1
        while node[0]:
            held = [x[live, node] for x in nodes]
            leaf, height, item, *lost = play(leaf, height, item, *held)
            for x, value in zip(nodes, lost, strict=True):
                x[live, node] = value
            node = node >> 1
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    by_tree = np.argsort(np.concatenate(tree), kind="stable")
    return np.concatenate(out)[by_tree], np.concatenate(met)[by_tree]


def _less(words: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """(a is not greater, bytes shared) where ``known`` bytes are known to be shared: comparing begins behind them."""
    first, met = np.ones(len(a), bool), np.full(len(a), whole)
    left, k = np.flatnonzero(known < whole), known >> 3
    while len(left):
        x, y = words[a[left], k[left]], words[b[left], k[left]]
        differ = x ^ y
        done = differ != 0
        hit = left[done]
        first[hit] = x[done] < y[done]
        met[hit] = 8 * k[hit] + 7 - np.searchsorted(_POWERS, differ[done], "right")
        left = left[~done]
        k[left] += 1
        left = left[k[left] < words.shape[1]]
    return first, met


def _fewer_runs(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """TREE runs made of neighbouring ones by sorting: (words, shared bytes, starts, where each row came from)."""
    edges = starts[np.linspace(0, len(starts) - 1, TREE + 1).astype(np.int64)]
    back = np.concatenate([a + order_of(words[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    words = words[back]
    common = np.zeros(len(words), np.int64)
    common[1:] = shared(words[1:], words[:-1])
    return words, common, edges, back


def _subranges(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run begins and ends in each sub-range."""
    text = np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * words.shape[1]}").ravel()
    wanted = max(1, len(words) // SUBRANGE)
    sample = np.arange(0, len(words), max(1, len(words) // (8 * wanted)))
    sample = sample[order_of(words[sample])]
    pivots = text[sample[np.linspace(0, len(sample), wanted + 1).astype(np.int64)[1:-1]]] if len(sample) else text[:0]
    cuts = [np.concatenate(([a], a + np.searchsorted(text[a:b], pivots), [b])) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    table = np.stack(cuts, axis=1)
    return table[:-1], table[1:]


# -- a block's part -------------------------------------------------------------------------------------------------------


class Text:
    """A block with what it was answered so far."""

    def __init__(self, row: dict, answers: list[dict], length: int, bits: int):
        self.length, self.bits, self.number = length, np.uint64(64 - bits), row["block"]
        self.ids = np.array([0 if x is None else x for x in row["ids"]], np.int64)
        self.has_id = np.array([x is not None for x in row["ids"]], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.text = zstandard.decompress(row["text"]) if row["text"] else b""
        self.answers = answers

    def stretches(self) -> Stretches:
        return stretches(self.text, self.sizes, self.has_id, self.length)

    def _answered(self, stage: int, run: int = 0, column: str = "bits") -> np.ndarray:
        mine = sorted((x for x in self.answers if x["stage"] == stage and x["run"] == run), key=lambda x: x["bucket"])
        return np.concatenate([np.empty(0, bool), *(np.unpackbits(expand(x[column], "u1"), count=x["n"]).astype(bool) for x in mine)])

    def _held(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints, and whether two rows of this block have one."""
        keys = hashes >> self.bits
        order = np.argsort(keys)
        ids = self.ids[row[order]]
        begin = _edges(keys[order])
        return keys[order][begin], np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin) if len(begin) else np.empty(0, bool)

    def ask_grams(self) -> tuple[np.ndarray, np.ndarray]:
        found = self.stretches()
        return self._held(found.key, found.row)

    def candidates(self) -> Stretches:
        """The stretches whose gram is in two rows: found, or as kept from an earlier reading."""
        kept = [x for x in self.answers if x["stage"] == 0]
        if kept:
            row, key, first, more = (expand(kept[0][c], kind) for c, kind in (("row", "i4"), ("key", "u8"), ("first", "i8"), ("more", "u1")))
            first = np.cumsum(first)
            return Stretches(np.frombuffer(self.text + bytes(8 * words_of(self.length) + GRAM), np.uint8), self.length, row.astype(np.int64), key, first, first + more)
        found = self.stretches()
        _, place, _ = distinct(found.key >> self.bits)
        return found.subset(self._answered(1)[place])

    def kept_candidates(self, found: Stretches) -> dict:
        columns = {"row": found.row.astype(np.int32), "key": found.key, "first": np.diff(found.first, prepend=0), "more": (found.last - found.first).astype(np.uint8)}
        return {"stage": 0, "block": self.number, "run": 0, "bucket": 0, "n": len(found.key)} | {c: squeeze(x) for c, x in columns.items()}

    def forms(self, found: Stretches) -> Forms:
        form = np.concatenate([np.empty(0, np.uint64), *(hash_words(read_words(found.text, found.first[a:b], found.sizes[a:b], words_of(self.length))) for a, b in _steps(len(found.key), RUN))])
        order = np.lexsort((form, found.key))
        key, form, ids = found.key[order], form[order], self.ids[found.row]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (form[1:] != form[:-1])
        place = np.empty(len(key), np.int64)
        place[order] = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        least, most = (f.reduceat(ids[order], begin) if len(key) else ids for f in (np.minimum, np.maximum))
        return Forms(key[new], form[new], least, least != most, place, ids)

    def parts(self, found: Stretches, forms: Forms) -> tuple[np.ndarray, np.ndarray]:
        """(row, start) of the strings of stretches that may be the first of several."""
        alone = found.subset(self._answered(2)[forms.place] & (forms.ids == forms.least[forms.place]))
        count = alone.last - alone.first + 1
        of = np.repeat(np.arange(len(count)), count)
        return alone.row[of], alone.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)

    def ask_parts(self, found: Stretches) -> tuple[np.ndarray, np.ndarray]:
        row, start = self.parts(found, self.forms(found))
        return self._held(string_hashes(found.text, start, self.length), row)

    def strings(self, found: Stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, size) of what is sorted: stretches and single strings that two rows have."""
        forms = self.forms(found)
        whole = found.subset(self._answered(2, column="own")[forms.place])
        row, start = self.parts(found, forms)
        _, place, _ = distinct(string_hashes(found.text, start, self.length) >> self.bits)
        some = self._answered(3)[place]
        join = lambda a, b: np.concatenate([a, b])
        return join(whole.row, row[some]), join(whole.first, start[some]), join(whole.sizes, np.full(int(some.sum()), self.length))

    def runs(self) -> Iterator[Run]:
        found = self.candidates()
        row, start, size = self.strings(found)
        for number, (a, b) in enumerate(_steps(len(row), RUN)):
            words = read_words(found.text, start[a:b], size[a:b], words_of(self.length))
            order = order_of(words)
            words = words[order]
            new = np.ones(len(words), bool)
            new[1:] = (words[1:] != words[:-1]).any(axis=1)
            ids = self.ids[row[a:b][order]]
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new) - 1
            yield Run(number, words[new], np.minimum.reduceat(ids, np.flatnonzero(new)), place, row[a:b], self.ids[row[a:b]], start[a:b], size[a:b])

    def left(self) -> tuple[list[np.ndarray], list[bytes]]:
        """Of each text: the spans that go, as one (start, end) after the other, and the bytes that stay."""
        starts, stops, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for run in self.runs():
            gone = self._answered(4, run.number)[run.place] | (run.id > run.least[run.place])
            starts.append(run.start[gone])
            stops.append(run.start[gone] + run.size[gone])
            rows.append(run.row[gone])
        starts, stops, rows = (np.concatenate(x) for x in (starts, stops, rows))
        order = np.argsort(starts)
        starts, rows, reach = starts[order], rows[order], np.maximum.accumulate(stops[order])
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] > reach[:-1]) | (rows[1:] != rows[:-1])
        begin = np.flatnonzero(new)
        spans = np.stack([starts[begin], reach[np.append(begin[1:], len(starts))[: len(begin)] - 1]], axis=1)
        ends = np.cumsum(self.sizes)
        bounds = np.searchsorted(rows[begin], np.arange(len(ends) + 1))
        found, texts = [], []
        for i, (size, end) in enumerate(zip(self.sizes.tolist(), ends.tolist(), strict=True)):
            own = spans[bounds[i] : bounds[i + 1]]
            edges = [end - size, *own.ravel().tolist(), end]
            texts.append(b"".join(self.text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            found.append(own - (end - size))
        return found, texts


@dataclass
class Forms:
    """Distinct (gram, hash of stretch) of a block, ordered, with the least id of each and whether two ids have it;
    ``place`` and ``ids`` are those of each stretch."""

    key: np.ndarray
    form: np.ndarray
    least: np.ndarray
    twice: np.ndarray
    place: np.ndarray
    ids: np.ndarray


@dataclass
class Run:
    number: int
    words: np.ndarray  # sorted, distinct
    least: np.ndarray  # least id of each
    place: np.ndarray  # of each occurrence among them
    row: np.ndarray
    id: np.ndarray
    start: np.ndarray
    size: np.ndarray


def _edges(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)


def _steps(n: int, step: int) -> list[tuple[int, int]]:
    return [(a, min(a + step, n)) for a in range(0, n, step)]


# -- messages -------------------------------------------------------------------------------------------------------------

BLOCKS = "block long, ids array<long>, sizes array<long>, text binary, n_bytes long"
ASKED = "kind string, stage int, block long, run int, bucket long, n int, keys binary, more binary, rest binary, least binary"
ANSWERED = "block long, stage int, run int, bucket long, n int, bits binary, own binary, row binary, key binary, first binary, more binary"
#: Questions, and what a block keeps for itself.
_WITH_BOTH = ", ".join([ASKED, *(x for x in ANSWERED.split(", ") if x not in ASKED.split(", "))])
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _batch(shape: str, rows: list[dict]) -> pa.RecordBatch:
    fields = [x.split() for x in shape.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[k]) for n, k in fields], names=[n for n, _ in fields])


def _dealt(keys: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys of so many bits, for the buckets that have any."""
    high = keys >> np.uint64(max(bits - 32, 0))
    bucket = (high * np.uint64(buckets)) >> np.uint64(min(bits, 32))
    begin = _edges(bucket)
    yield from zip(bucket[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), *[len(keys)] * (len(begin) > 0)], strict=True)


def into_blocks(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for part in slices(batch, 1):
                more = as_bytes(part.column(1))
                ids += part.column(0).to_pylist()
                texts += more
                held += sum(map(len, more))
                if held >= block or len(ids) >= block >> 4:
                    yield row(number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield row(number, ids, texts)

    def row(number: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(texts)
        return _batch(BLOCKS, [{"block": number, "ids": ids, "sizes": list(map(len, texts)), "text": zstandard.compress(whole, 1), "n_bytes": len(whole)}])

    return slim.mapInArrow(run, BLOCKS)


def answer(asked: pa.Table) -> pa.Table:
    """Stages 1 and 3: is a fingerprint held by two rows? Stage 2: has a gram several stretches, and is no id with this one
    smaller; and have two rows this one (``own``)? One bit for each key."""
    rows = asked.sort_by("block").to_pylist()
    keys = [np.cumsum(expand(x["keys"], "u8"), dtype=np.uint64) for x in rows]
    flat = np.concatenate(keys)
    own = None
    if rows[0]["stage"] != 2:
        known, place, _ = distinct(flat)
        twice = np.concatenate([np.unpackbits(expand(x["more"], "u1"), count=len(k)).astype(bool) for x, k in zip(rows, keys, strict=True)])
        yes = np.bincount(place, minlength=len(known)) > 1
        yes[place[twice]] = True
        yes = yes[place]
    else:
        form, least = (np.concatenate([expand(x[c], kind) for x in rows]) for c, kind in (("more", "u8"), ("least", "i8")))
        order = np.lexsort((least, form, flat))
        begin = _edges(flat[order])
        several = np.minimum.reduceat(form[order], begin) != np.maximum.reduceat(form[order], begin)
        new = np.ones(len(order), bool)
        new[1:] = (flat[order][1:] != flat[order][:-1]) | (form[order][1:] != form[order][:-1])
        begin_form = np.flatnonzero(new)
        lowest = least[order][begin_form][np.cumsum(new) - 1]
        twice = np.concatenate([np.unpackbits(expand(x["rest"], "u1"), count=len(k)).astype(bool) for x, k in zip(rows, keys, strict=True)])
        count = np.diff(np.append(begin_form, len(order)))
        own = np.empty(len(order), bool)
        own[order] = np.repeat((count > 1) | np.logical_or.reduceat(twice[order], begin_form), count)
        yes = np.empty(len(order), bool)
        yes[order] = np.repeat(several, np.diff(np.append(begin, len(order)))) & (least[order] == lowest)
    each = np.split(yes, np.cumsum([len(k) for k in keys])[:-1])
    owned = np.split(own, np.cumsum([len(k) for k in keys])[:-1]) if own is not None else [None] * len(rows)
    packed = lambda x: None if x is None else squeeze(np.packbits(x))
    out = [{"block": x["block"], "stage": x["stage"], "run": 0, "bucket": x["bucket"], "n": len(bits), "bits": packed(bits), "own": packed(mine)} for x, bits, mine in zip(rows, each, owned, strict=True)]
    return pa.Table.from_batches([_batch(ANSWERED, out)])


def merge_range(asked: pa.Table, wide: int) -> pa.Table:
    """One range: merges its runs; for each suffix of each run, has another run it from a smaller id?"""
    rows = asked.sort_by([("block", "ascending"), ("run", "ascending")]).to_pylist()
    common = [expand(x["keys"], "u1").astype(np.int64) for x in rows]
    words = np.concatenate([front_decode(c, expand(x["more"], "u1"), zstandard.decompress(x["rest"]), wide) for x, c in zip(rows, common, strict=True)])
    starts = np.append(0, np.cumsum([x["n"] for x in rows]))
    order, met = merge_runs(words, np.concatenate(common), starts)
    least = np.concatenate([expand(x["least"], "i8") for x in rows])
    begin = np.flatnonzero(met < 8 * wide)
    lowest = np.minimum.reduceat(least[order], begin)
    smaller = np.empty(len(order), bool)
    smaller[order] = lowest[np.cumsum(met < 8 * wide) - 1] < least[order]
    out = [{"block": x["block"], "stage": 4, "run": x["run"], "bucket": x["bucket"], "n": x["n"], "bits": squeeze(np.packbits(smaller[a:b]))} for x, a, b in zip(rows, starts[:-1], starts[1:], strict=True)]
    return pa.Table.from_batches([_batch(ANSWERED, out)])


def send_runs(text: Text, splitters: np.ndarray) -> list[dict]:
    """The parts of each run between splitters, front-coded."""
    rows, wide = [], words_of(text.length)
    for run in text.runs():
        whole = np.ascontiguousarray(run.words.astype(">u8")).view(f"S{8 * wide}").ravel()
        bucket = np.searchsorted(splitters, whole, "right")
        begin = _edges(bucket)
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(bucket)).tolist(), strict=True):
            common, sizes, rest = front_code(run.words[a:b])
            rows.append({"kind": "run", "stage": 4, "block": text.number, "run": run.number, "bucket": int(bucket[a]), "n": b - a, "keys": squeeze(common), "more": squeeze(sizes), "rest": zstandard.compress(rest, 1), "least": squeeze(run.least[a:b])})
    return rows


# -- the operator ---------------------------------------------------------------------------------------------------------


def repeated_passages(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bucket: int = BUCKET, per_range: int = RANGE) -> DataFrame:
    """One row per row of ``docs``: id (long), n_bytes, spans (start and end of each removed run of bytes) and kept."""
    if not GRAM <= length <= 128:
        raise ValueError(f"length must be {GRAM} to 128")
    spark = docs.sparkSession
    parts, wide = parallelism(spark), words_of(length)
    name = f"sitelode_texts_{uuid.uuid4().hex}"
    path = shared_path(spark, "texts")
    into_blocks(docs, id_col, text_col, block).write.bucketBy(parts, "block").option("path", path).option("compression", "none").saveAsTable(name)
    try:
        return _removed(spark.table(name), length, wide, parts, bucket, per_range).withColumnRenamed("_id", id_col)
    finally:
        spark.sql(f"DROP TABLE {name}")  # its name only: the files are in the shared folder, and the plan has them


def _removed(blocks: DataFrame, length: int, wide: int, parts: int, bucket: int, per_range: int) -> DataFrame:
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    grams = 2 * total // (length - GRAM + 2) + 1
    bits = min(64, grams.bit_length() + 12)  # one false alarm in 4,096 grams
    buckets = max(parts, math.ceil(grams / bucket))

    def message(stage: int, number: int, i: int, keys: np.ndarray, twice: np.ndarray) -> dict:
        return {"kind": "ask", "stage": stage, "block": number, "run": 0, "bucket": i, "keys": squeeze(np.diff(keys, prepend=np.uint64(0))), "more": squeeze(np.packbits(twice))}

    def ask_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                keys, twice = Text(row, [], length, bits).ask_grams()
                yield _batch(ASKED, [message(1, row["block"], i, keys[a:b], twice[a:b]) for i, a, b in _dealt(keys, bits, buckets)])

    def with_answers(work, shape: str):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = [x for row in left.to_pylist() for x in work(Text(row, right.to_pylist(), length, bits))]
            return pa.Table.from_batches([_batch(shape, rows)])

        return run

    columns = ["block", "ids", "sizes", "text"]
    by_block = lambda answers: blocks.select(*columns).groupBy("block").cogroup(answers.groupBy("block"))
    asked_names, answered_names = ([x.split()[0] for x in shape.split(", ")] for shape in (ASKED, ANSWERED))

    def stored(df: DataFrame, what: str, shape: str) -> DataFrame:
        path = shared_path(spark, what)
        df.write.option("compression", "none").parquet(path)
        return spark.read.schema(shape).parquet(path)

    asked = blocks.select(*columns).mapInArrow(ask_held, ASKED)
    held = stored(asked.groupBy("bucket").applyInArrow(answer, ANSWERED), "held", ANSWERED)

    def ask_forms(text: Text) -> list[dict]:
        found = text.candidates()
        forms = text.forms(found)
        rows = [{"kind": "ask", "stage": 2, "block": text.number, "run": 0, "bucket": i, "keys": squeeze(np.diff(forms.key[a:b], prepend=np.uint64(0))), "more": squeeze(forms.form[a:b]), "least": squeeze(forms.least[a:b]), "rest": squeeze(np.packbits(forms.twice[a:b]))} for i, a, b in _dealt(forms.key, 64, buckets)]
        return [*rows, {"kind": "kept"} | text.kept_candidates(found)]

    second = stored(by_block(held).applyInArrow(with_answers(ask_forms, _WITH_BOTH), _WITH_BOTH), "forms", _WITH_BOTH)
    known = second.filter("kind = 'kept'").select(*answered_names)
    ask = lambda d: d.filter("kind = 'ask'").select(*asked_names).groupBy("bucket").applyInArrow(answer, ANSWERED)
    known = known.unionByName(stored(ask(second), "several", ANSWERED))

    def ask_parts(text: Text) -> list[dict]:
        found = text.candidates()
        keys, twice = text.ask_parts(found)
        rows = [message(3, text.number, i, keys[a:b], twice[a:b]) for i, a, b in _dealt(keys, bits, buckets)]
        # Regular samples of what will be sorted; ``n`` has the most that it can be.
        first = found.first[::EVERY]
        if len(first):
            sample = read_words(found.text, first, np.full(len(first), length), wide)
            rows.append({"kind": "sample", "stage": 3, "block": text.number, "run": 0, "bucket": 0, "n": len(found.first) + len(keys), "rest": sample.astype(">u8").tobytes()})
        return rows

    third = stored(by_block(known).applyInArrow(with_answers(ask_parts, ASKED), ASKED), "parts", ASKED)
    known = known.unionByName(stored(ask(third), "repeated", ANSWERED))
    splitters = _splitters(third.filter("kind = 'sample'"), wide, parts, per_range)

    runs = by_block(known).applyInArrow(with_answers(lambda text: send_runs(text, splitters), ASKED), ASKED)
    merged = stored(runs.groupBy("bucket").applyInArrow(lambda t: merge_range(t, wide), ANSWERED), "merged", ANSWERED)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n_bytes, spans, kept = [], [], [], []
        for row in left.to_pylist():
            text = Text(row, right.to_pylist(), length, bits)
            some, rest = text.left()
            ids += row["ids"]
            n_bytes += row["sizes"]
            spans += some
            kept += rest
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        flat = np.concatenate([np.empty((0, 2), np.int64), *spans])
        offsets = pa.array(np.append(0, np.cumsum([len(x) for x in spans])), pa.int32())
        listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], fields=list(span)))
        return pa.table([pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), listed, pa.array(kept, pa.binary())], names=["_id", "n_bytes", "spans", "kept"])

    return by_block(known.unionByName(merged)).applyInArrow(finish, "_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _splitters(samples: DataFrame, wide: int, parts: int, per_range: int) -> np.ndarray:
    """Where ranges of about ``per_range`` suffixes are cut. The driver gets at most SAMPLES strings for each range."""
    # 640 bytes for each half million suffixes, and a string of ``width`` bytes for each range in the tasks.
    total = samples.agg(F.sum("n")).first()[0] or 0
    ranges = max(parts, math.ceil(total / per_range))
    width = 8 * wide
    each = F.explode(F.sequence(F.lit(0), (F.octet_length("rest") / width).cast("int") - 1))
    strings = samples.select("rest", each.alias("i")).select(F.substring("rest", F.col("i") * width + 1, F.lit(width)).alias("s")).distinct()
    wanted = ranges * SAMPLES
    drawn = strings.orderBy(F.xxhash64("s"), "s").limit(wanted).toArrow()["s"].to_pylist()  # a bounded heap in each task
    found = np.sort(np.array(drawn, f"S{width}")) if drawn else np.empty(0, f"S{width}")
    return np.unique(found[np.linspace(0, len(found), ranges + 1).astype(np.int64)[1:-1]]) if len(found) else found
