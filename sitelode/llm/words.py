"""Words of Arrow batches as numpy arrays: one pass of splitting, then everything else works on word numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import LOWER, UPPER

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 2 << 20
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have ``most`` bytes together, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null: empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


#: Pieces of up to so many bytes are hashed eight bytes at a time; longer ones by a library, one by one.
SHORT = 32
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Pieces:
    """Runs of bytes of many texts, numbered so that equal runs have equal numbers.

    ``text`` holds all texts and SHORT spare bytes behind them; ``counts`` has the pieces of each text. Pieces are told
    apart by 64-bit hashes of their bytes: two of one batch clash with a probability below 1e-8.
    """

    raw: list[bytes]
    text: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray

    @cached_property
    def _numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return distinct(piece_hashes(self.text, self.starts, self.lengths))

    @property
    def hashes(self) -> np.ndarray:
        """The hash of each distinct piece, ascending; the same wherever the piece is met."""
        return self._numbered[0]

    @property
    def ids(self) -> np.ndarray:
        """The number of each piece among the distinct ones."""
        return self._numbered[1]

    @property
    def size(self) -> int:
        return len(self.hashes)

    def as_list(self, which: np.ndarray) -> list[bytes]:
        """Some distinct pieces as bytes."""
        at = self._numbered[2][which]
        data = self.text.tobytes()
        return [data[a:b] for a, b in zip(self.starts[at].tolist(), (self.starts[at] + self.lengths[at]).tolist(), strict=True)]

    def spaced(self, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pieces (all, or some) between single spaces, as bytes; start of each (its first byte), and length."""
        at = self._numbered[2] if which is None else self._numbered[2][which]
        lengths = self.lengths[at]
        starts = 1 + np.cumsum(lengths + 1) - (lengths + 1)
        data = np.full(1 + int((lengths + 1).sum()), 32, np.uint8)
        data[1:] = self.text[np.repeat(self.starts[at] - starts + 1, lengths + 1) + np.arange(len(data) - 1)]
        data[starts + lengths] = 32
        return data, starts, lengths

    @cached_property
    def doc(self) -> np.ndarray:
        """The number of the text of each piece."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums one value per piece over each text."""
        return segment_sums(values, self.counts)


class Words(Pieces):
    """The words of texts."""

    @classmethod
    def of(cls, raw: list[bytes], lower: bool = False) -> Words:
        data = b" ".join([b"", *raw, b" " * SHORT])
        text = np.frombuffer(data.translate(TO_LOWER) if lower else data, np.uint8)
        space = _IS_SPACE[text]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts = edges[::2]
        bounds = np.cumsum([1, *(len(x) + 1 for x in raw)])
        return cls(raw, text, starts, edges[1::2] - starts, np.diff(np.searchsorted(starts, bounds)))

    @cached_property
    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spaced()

    def windows(self, n: int) -> np.ndarray:
        """Positions at which n words in a row belong to one text."""
        if len(self.ids) < n:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.ids) - n + 1] == self.doc[n - 1 :])


def piece_hashes(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; ``text`` must go on for SHORT bytes behind the last."""
    eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    take = lambda at, k: eight[starts[at] + 8 * k] & _KEEP[np.minimum(lengths[at] - 8 * k, 8)]
    out = mix(take(slice(None), 0) ^ mix(lengths.astype(np.uint64)))
    for k in range(1, SHORT // 8):
        at = np.flatnonzero(lengths > 8 * k)
        if len(at):
            out[at] = mix(out[at] * np.uint64(0x9E3779B97F4A7C15) + take(at, k))
    for i in np.flatnonzero(lengths > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[starts[i] : starts[i] + lengths[i]])
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, the place of each key among them, one position of each)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place, order[new]


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values; an empty run gives 0. A run's sum depends on its values alone."""
    if values.dtype.kind == "f":
        return np.bincount(np.repeat(np.arange(len(counts)), counts), values, len(counts))
    ends = np.cumsum(counts)
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[ends] - total[ends - counts]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
