"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field and rebuilt as a ``tokenizers`` pipeline: normaliser (character map, white-space
rule, dummy prefix and the metaspace marker), the vocabulary as unigram scores or, for a model of the other kind, as the
merges that its scores imply, and byte fallback.

At scale, texts are encoded through their distinct chunks (``chunks.py``): where no piece has the marker after another
character, no piece can cross the beginning of a run of markers, so chunks that begin there are independent; a model
without that property is encoded by whole texts. Every distinct chunk that a worker encodes is also encoded by the
``sentencepiece`` library; where the two differ the latter's ids are taken, and ``parity`` is false for the texts that
hold such a chunk. Decoding is done on the final ids and compared with the text.

A null or empty text has no ids. A text that holds the marker itself does not survive decoding (the format cannot tell it
from a space), and neither does one that a lossy normaliser changes: ``round_trip`` is false there. Repeated rows and ids
are encoded each on their own; an empty table gives no rows; only the id and text columns are read, so other columns may
have any names.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable
from .words import SHORT, Pieces, as_bytes, segment_sums, slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
THREADS = 2
# Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as numbers, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            size = varint()
        if at + size > len(data):
            raise ValueError("the message is cut short")
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        (score,) = struct.unpack("<f", v)
                    elif n == 3:
                        kind = v
                model.pieces.append(piece)
                model.scores.append(score)
                model.kinds.append(kind)
            elif number == 2:
                spec = dict(fields(value))
                model.model_type, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                model.charsmap = spec.get(2, b"")
                model.add_dummy_prefix, model.remove_extra_whitespaces, model.escape_whitespaces = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        return model

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    @property
    def parts_at_marks(self) -> bool:
        """True if texts can be cut before each run of markers: no piece crosses, and nothing but spaces is rewritten."""
        whole = all(MARK not in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER))
        return whole and self.escape_whitespaces and not self.charsmap and not self.remove_extra_whitespaces

    def merges(self) -> list[tuple[str, str]]:
        """The pairs whose concatenation is a piece, best score first."""
        usable = {p: s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True) if k in (NORMAL, USER, UNUSED)}
        found = [(-s, i, p[:i], p[i:]) for p, s in usable.items() for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self, normalise: bool = True):  # noqa: ANN201
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        unk = self.unknown
        if self.model_type == UNIGRAM:
            made = Tokenizer(models.Unigram(list(zip(self.pieces, self.scores, strict=True)), unk, self.byte_fallback))
        elif self.model_type == BPE:
            made = Tokenizer(models.BPE({p: i for i, p in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[unk], fuse_unk=True, byte_fallback=self.byte_fallback))
        else:
            raise ValueError(f"model type {self.model_type}")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra_whitespaces:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if self.add_dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        if normalise and steps:
            made.normalizer = normalizers.Sequence(steps)
        strip = [decoders.Strip(" ", 1, 0)] if self.add_dummy_prefix else []
        made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return made

    def id_bytes(self) -> list[bytes]:
        """What each id contributes to a decoded text."""
        out = []
        for p, k in zip(self.pieces, self.kinds, strict=True):
            out.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode())
        return out


class Backend:
    """One worker's encoder for a model file's bytes."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece

        self.model = PieceModel.parse(data)
        self.threads = threads
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_chunk = self.model.parts_at_marks
        self.tokenizer = self.model.tokenizer(normalise=not self.by_chunk)
        each = self.model.id_bytes()
        self.bytes, self.lengths = np.frombuffer(b"".join(each), np.uint8), np.array([len(x) for x in each])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.table = ChunkTable(self._chunks)

    def _chunks(self, pieces: Pieces, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks begin with a run of spaces (which may be empty only for a text's first chunk without dummy prefix).
        Marked are those on which the two libraries differ."""
        chunks = [x.decode() for x in pieces.as_list(new)]
        made = [x.ids for x in self.tokenizer.encode_batch_fast([c.replace(" ", MARK) for c in chunks], add_special_tokens=False)]
        # The library adds the dummy prefix itself, so one leading space is left to it; a lone one it takes for no text.
        drop = int(self.model.add_dummy_prefix)
        wanted = self.reference.encode([c[drop:] if c.startswith(" ") else c for c in chunks], num_threads=self.threads)
        differ = np.array([a != b and len(c) > drop for a, b, c in zip(made, wanted, chunks, strict=True)], bool)
        for i in np.flatnonzero(differ).tolist():
            made[i] = wanted[i]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum())), sizes, differ

    def encode(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids of each text, whether both libraries agree on the text)."""
        if not self.by_chunk:
            texts = [x.decode() for x in raw]
            made = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
            wanted = self.reference.encode(texts, num_threads=self.threads) if texts else []
            same = np.array([a == b for a, b in zip(made, wanted, strict=True)], bool)
            sizes = np.fromiter(map(len, wanted), np.int64, len(wanted))
            return np.fromiter(chain.from_iterable(wanted), np.uint32, int(sizes.sum())), sizes, same
        pieces = parted(raw, self.model.add_dummy_prefix)
        rows = self.table.rows(pieces)[pieces.ids]
        ids, sizes = self.table.gather(rows, pieces.counts)
        return ids, sizes, segment_sums(self.table.marks[rows].astype(np.int64), pieces.counts) == 0

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_all(ids, np.array([len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts of ids in a row, ``sizes`` of each."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        data = self.bytes[np.repeat(self.begins[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()
        bounds = np.append(0, ends)[np.append(0, np.cumsum(sizes))].tolist()
        drop = self.model.add_dummy_prefix
        return [data[a + (drop and data[a : a + 1] == b" ") : b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def parted(raw: list[bytes], prefix: bool) -> Pieces:
    """The texts, each with its dummy prefix unless empty, cut before each run of spaces."""
    raw = [x.replace(MARK.encode(), b" ") for x in raw]  # the marker in a text is a space to the model
    texts = [b" " + x if x else x for x in raw] if prefix else raw
    text = np.frombuffer(b"".join([*texts, b" " * SHORT]), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    space = text[: bounds[-1]] == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(begins)
    return Pieces(raw, text, starts, np.diff(starts, append=bounds[-1]), np.diff(np.searchsorted(starts, bounds)))


_BACKENDS: dict[tuple[str, int], Backend] = {}


def backend(path: str | None = None, threads: int = THREADS) -> Backend:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    if (path, threads) not in _BACKENDS:
        with open(path, "rb") as f:
            _BACKENDS[path, threads] = Backend(f.read(), threads)
    return _BACKENDS[path, threads]


def encode(docs: DataFrame, model: str | None = None, threads: int = THREADS, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_ids, ids_crc32 and ids_sha256 (of little-endian unsigned 32-bit ids), parity, round_trip, and the ids.

    ``model`` is a path on every worker; by default that of the installed public model.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = backend(model, threads)
        for batch in batches:
            for part in slices(batch, 1):
                raw = as_bytes(part.column(1))
                ids, sizes, same = used.encode(raw)
                ids = ids.astype("<u4")
                stops = np.cumsum(sizes)
                own = [ids[e - n : e] for e, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
                data = [x.tobytes() for x in own]
                trip = [x == text for x, text in zip(used.decode_all(ids, sizes), raw, strict=True)]
                arrays = [pa.array([len(x) for x in raw], pa.int64()), pa.array(sizes), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data]), pa.array(same), pa.array(trip, pa.bool_())]
                if keep_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["_id", *names])

    names = ["n_bytes", "n_ids", "ids_crc32", "ids_sha256", "parity", "round_trip", *(["ids"] if keep_ids else [])]
    shape = f"_id {kind}, n_bytes long, n_ids long, ids_crc32 long, ids_sha256 string, parity boolean, round_trip boolean" + ", ids array<int>" * keep_ids
    return slim.mapInArrow(run, shape).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, model: str | None = None, threads: int = THREADS, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and decoded text of arrays of ids; null ids: null; bytes that are no UTF-8 become U+FFFD."""
    slim = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    kind = slim.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = backend(model, threads)
        for batch in batches:
            ids = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = used.decode_all(ids.flatten().to_numpy(zero_copy_only=False), sizes)
            held = [t.decode(errors="replace") if ok else None for ok, t in zip(ids.is_valid().to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.string())], names=["_id", "text"])

    return slim.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)
