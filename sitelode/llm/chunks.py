"""Token ids of texts through the ids of their distinct chunks.

Where a tokenizer never looks across a boundary, the ids of a text are the ids of its chunks in a row. Each distinct chunk
is encoded once in a worker process and kept in flat arrays of at most MOST_BYTES; a table that grows beyond that starts
anew. Texts are then built by gathering. The result is that of encoding whole texts, which tests verify.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import Pieces

#: What a worker keeps between slices, in bytes.
MOST_BYTES = 48 << 20

#: Takes the pieces and the numbers of those to encode; gives all ids in a row, ids of each, and a mark of each.
Encode = Callable[[Pieces, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


class ChunkTable:
    def __init__(self, encode: Encode, most_bytes: int = MOST_BYTES):
        self.encode, self.most_bytes = encode, most_bytes
        self.forget()

    def forget(self) -> None:
        self.keys, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted hashes, and the row of each
        self.count, self.used = 0, 0
        self.starts, self.sizes, self.marks = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.flat = np.empty(0, np.uint32)

    @property
    def held_bytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.row, self.starts, self.sizes, self.marks, self.flat))

    def rows(self, pieces: Pieces) -> np.ndarray:
        """The row of each distinct piece; encodes those that are new."""
        at, known = self._find(pieces.hashes)
        new = np.flatnonzero(~known)
        if len(new):
            if self.held_bytes > self.most_bytes:
                self.forget()
                new = np.arange(pieces.size)
            self._add(pieces, new)
            at, _ = self._find(pieces.hashes)
        return self.row[at] if pieces.size else at

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, hashes)
        if not len(self.keys):
            return at, np.zeros(len(hashes), bool)
        at = np.minimum(at, len(self.keys) - 1)
        return at, self.keys[at] == hashes

    def _add(self, pieces: Pieces, new: np.ndarray) -> None:
        flat, sizes, marks = self.encode(pieces, new)
        self.flat = _put(self.flat, self.used, flat.astype(np.uint32, copy=False))
        self.starts = _put(self.starts, self.count, self.used + np.cumsum(sizes) - sizes)
        self.sizes = _put(self.sizes, self.count, sizes)
        self.marks = _put(self.marks, self.count, marks)
        keys = np.concatenate([self.keys, pieces.hashes[new]])
        order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
        self.row = np.concatenate([self.row, np.arange(self.count, self.count + len(new))])[order]
        self.keys = keys[order]
        self.count, self.used = self.count + len(new), self.used + len(flat)

    def gather(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each; ``rows`` has a table row for each chunk."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        return ids, np.diff(bounds)


def _put(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``more`` behind the first ``used`` entries; room grows by doubling."""
    if used + len(more) > len(held):
        grown = np.empty(max(used + len(more), 2 * len(held)), held.dtype)
        grown[:used] = held[:used]
        held = grown
    held[used : used + len(more)] = more
    return held
