"""Packing documents into training windows in bounded space.

Each partition streams its documents past a fixed number of open windows. A document longer than a window fills windows
of its own and goes on with what is left; a piece goes to the window that it fills best; when none has room, the fullest
window is closed, after the head of the piece has filled its gap where the gap is worth a cut. What is still open at the
end of a partition is written apart with its ids, and merged over groups of partitions, so that no task ever sees more
than GROUP * OPEN windows.

A document is its ids followed by END, so a null or empty text is one id. Each id lies in exactly one piece. Repeated
rows and ids are packed each on their own; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable
from .common import LOWER, UPPER, written
from .words import TO_LOWER, Pieces, Words, as_bytes, segment_sums, slices

WINDOW = 2048
#: Open windows of a partition.
OPEN = 32
#: A gap of at least so many ids is filled by cutting a piece.
CUT = 16
END = 1
#: Partitions whose leftovers are merged together.
GROUP = 16
TOKENIZER = "word_bpe_49k.json"

_IS_LETTER = np.isin(np.arange(256), list((LOWER + UPPER).encode()))
_IS_MARK = np.isin(np.arange(256), list(b".,;:!?&#$*%"))
_TABLES: dict[str, ChunkTable] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes chunks without white space.

    Letters alone give one run of tokens that ends with the only token with a word end, so many such chunks are encoded as
    one text with spaces between and cut apart afterwards. All else is encoded chunk by chunk.
    """

    TOGETHER = 512

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.fromiter(((self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)), bool, size)

    def __call__(self, pieces: Pieces, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, starts, lengths = pieces.spaced(new)
        letters = np.append(0, np.cumsum(letter_bytes(data)))
        plain = letters[starts + lengths] - letters[starts] == lengths
        ids, sizes = self._together(pieces, new[plain])
        found = [ids]
        if not plain.all():
            texts = [x.decode() for x in pieces.as_list(new[~plain])]
            each = [np.array(x, np.uint32) for x in self._batch(texts)]
            order = np.argsort(np.append(np.flatnonzero(plain), np.flatnonzero(~plain)))
            sizes = np.append(sizes, [len(x) for x in each]).astype(np.int64)
            flat = np.concatenate([*found, *each])
            starts = (np.cumsum(sizes) - sizes)[order]
            sizes = sizes[order]
            ids = flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))]
        return ids, sizes, np.zeros(len(new), bool)

    def _together(self, pieces: Pieces, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, starts, lengths = pieces.spaced(which)
        text = data.tobytes()
        edges = [*range(0, len(which), self.TOGETHER), len(which)]
        ids = [np.array(x, np.uint32) for x in self._batch([text[starts[a] : starts[b - 1] + lengths[b - 1]].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)])]
        flat = np.concatenate([np.empty(0, np.uint32), *ids])
        stops = np.flatnonzero(self.ends[flat]) + 1
        if len(stops) != len(which):
            raise ValueError(f"{len(which)} chunks of letters gave {len(stops)} word ends")
        return flat, np.diff(stops, prepend=0)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def parted(words: Words) -> Pieces:
    """The words with the marks of punctuation behind a letter at their end taken off as a piece of its own: this kind of
    tokenizer always parts the two, and far fewer pieces are distinct."""
    text, ends = words.text, words.starts + words.lengths
    before = np.maximum.accumulate(np.where(_IS_MARK[text], 0, np.arange(len(text))))[ends - 1]  # the last byte that is no mark
    tail = ends - 1 - before
    cut = (tail > 0) & (before >= words.starts) & letter_bytes(text)[before]
    times = 1 + cut
    starts, lengths = np.repeat(words.starts, times), np.repeat(words.lengths - np.where(cut, tail, 0), times)
    tails = np.cumsum(times)[cut] - 1
    starts[tails], lengths[tails] = before[cut] + 1, tail[cut]
    return Pieces(words.raw, text, starts, lengths, segment_sums(times, words.counts))


def letter_bytes(text: np.ndarray) -> np.ndarray:
    """The bytes of letters of ASCII and Latin-1: in UTF-8 those of the latter are C3 and one byte more."""
    second = np.zeros(len(text), bool)
    second[1:] = (text[:-1] == 0xC3) & (text[1:] != 0x97) & (text[1:] != 0xB7)
    lead = np.zeros(len(text), bool)
    lead[:-1] = second[1:]
    return _IS_LETTER[text] | second | lead


def chunk_table(path: str | None = None) -> ChunkTable:
    """This worker's table for a lower-casing word tokenizer that parts texts at white space."""
    path = path or tokenizer_path()
    if path not in _TABLES:
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        _TABLES[path] = ChunkTable(ChunkEncoder(path))
    return _TABLES[path]


def encode_texts(raw: list[bytes], table: ChunkTable) -> tuple[np.ndarray, np.ndarray]:
    # ASCII capitals are lower-cased by the tokenizer in any case; a marked special token in capitals is not one
    pieces = parted(Words.of([x if b"<|" in x else x.translate(TO_LOWER) for x in raw]))
    return table.gather(table.rows(pieces)[pieces.ids], pieces.counts)


class Packer:
    """Open windows of one partition. A window is [fill, number, pieces]; a piece is (id, start, doc_tokens, ids)."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN, cut: int = CUT):
        self.window, self.most_open, self.cut = window, most_open, cut
        self.open: list[list] = []  # by fill
        self.fills: list[int] = []
        self.number = 0
        self.closed: list[tuple[int, list]] = []

    def _close(self, number: int, pieces: list) -> None:
        self.closed.append((number, pieces))

    def _new(self) -> int:
        self.number += 1
        return self.number - 1

    def _put(self, fill: int, number: int, pieces: list) -> None:
        if fill == self.window:
            self._close(number, pieces)
            return
        at = bisect_left(self.fills, fill)
        self.fills.insert(at, fill)
        self.open.insert(at, [number, pieces])

    def add(self, doc: object, ids: np.ndarray, start: int = 0, doc_tokens: int | None = None) -> None:
        doc_tokens = len(ids) if doc_tokens is None else doc_tokens
        at, n = 0, len(ids)
        while n - at >= self.window:
            self._close(self._new(), [(doc, start + at, doc_tokens, ids[at : at + self.window])])
            at += self.window
        while at < n:
            left = n - at
            best = bisect_left(self.fills, self.window - left + 1) - 1  # the fullest with room for all that is left
            if best >= 0:
                fill, (number, pieces) = self.fills.pop(best), self.open.pop(best)
                self._put(fill + left, number, [*pieces, (doc, start + at, doc_tokens, ids[at:])])
                return
            if len(self.open) < self.most_open:
                self._put(left, self._new(), [(doc, start + at, doc_tokens, ids[at:])])
                return
            fill, (number, pieces) = self.fills.pop(), self.open.pop()
            gap = self.window - fill
            if gap >= self.cut:
                pieces = [*pieces, (doc, start + at, doc_tokens, ids[at : at + gap])]
                at += gap
            self._close(number, pieces)

    def drain(self) -> list[tuple[int, list]]:
        out, self.closed = self.closed, []
        return out


PIECES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _rows(sequences: list[tuple[int, list]], base: int, leftover: bool, id_type: pa.DataType, keep_ids: bool) -> pa.RecordBatch:
    cols: dict[str, list] = {k: [] for k in ("_id", *PIECES)}
    held: list[bytes | None] = []
    for number, pieces in sequences:
        offset = 0
        for doc, start, doc_tokens, ids in pieces:
            data = np.ascontiguousarray(ids, "<u4").tobytes()
            for k, v in zip(cols, (doc, start, len(ids), zlib.crc32(data), doc_tokens, base + number, offset), strict=True):
                cols[k].append(v)
            held.append(data if leftover or keep_ids else None)
            offset += len(ids)
    n = len(held)
    arrays = [pa.array(cols["_id"], id_type), *(pa.array(cols[k], pa.int64()) for k in PIECES), pa.array(held, pa.binary()), pa.array([leftover] * n, pa.bool_()), pa.array([base >> 32] * n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["_id", *PIECES, "ids", "leftover", "part"])


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, most_open: int = OPEN, cut: int = CUT, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, PIECES and, with ``keep_ids``, the ids as little-endian unsigned 32-bit bytes."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    shape = f"_id {kind}, {', '.join(f'{c} long' for c in PIECES)}, ids binary, leftover boolean, part long"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        table, packer, id_type = chunk_table(tokenizer), Packer(window, most_open, cut), None
        for batch in batches:
            id_type = batch.column(0).type
            for part in slices(batch, 1):
                flat, sizes = encode_texts(as_bytes(part.column(1)), table)
                stops = np.cumsum(sizes)
                flat = np.insert(flat, stops, END)
                stops = (stops + np.arange(1, len(stops) + 1)).tolist()
                for doc, a, b in zip(part.column(0).to_pylist(), [0, *stops[:-1]], stops, strict=True):
                    packer.add(doc, flat[a:b])
                yield _rows(packer.drain(), base, False, id_type, keep_ids)
        if id_type is not None:
            yield _rows([(x[0], x[1]) for x in packer.open], base, True, id_type, keep_ids)

    def merge(found: pa.Table) -> pa.Table:
        """Closes up the leftovers of a group, largest pieces first; one open window, so that only the last has a gap."""
        found = found.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        base = (1 << 62) + (found["group"][0].as_py() << 32)
        packer = Packer(window, 1, 1)
        cols = [found[c].to_pylist() for c in ("_id", "ids", "start", "doc_tokens")]
        for doc, data, start, doc_tokens in zip(*cols, strict=True):
            packer.add(doc, np.frombuffer(data, "<u4"), start, doc_tokens)
        rows = _rows([*packer.drain(), *((x[0], x[1]) for x in packer.open)], base, False, found.schema.field("_id").type, keep_ids)
        return pa.Table.from_batches([rows])

    placed = written(slim.mapInArrow(stream, shape), "packed")
    rest = placed.filter("leftover").withColumn("group", F.floor(F.col("part") / GROUP).cast("long"))
    merged = rest.groupBy("group").applyInArrow(merge, shape)
    return placed.filter("not leftover").unionByName(merged).select(F.col("_id").alias(id_col), *PIECES, *(["ids"] if keep_ids else []))
