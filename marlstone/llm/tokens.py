"""Vectorised word scanning over the UTF-8 buffers of Arrow string columns.

Words, their 64-bit hashes and the hashes of windows of consecutive words are
computed with numpy for a whole slice of documents at once, so that the
operators on words need no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_S29, _S32 = _U(29), _U(32)
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def byte_class(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Words are runs of anything but the ASCII white space 0x09-0x0D and 0x20.
NOT_SPACE = byte_class(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of ASCII digits, a-z (after lower-casing) and all non-ASCII characters.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step of the 64-bit hashes."""
    h = (h ^ (h >> _S29)) * _B
    return h ^ (h >> _S32)


@dataclass
class Words:
    """The words of some documents: ``start``/``end`` are byte offsets in ``data``, ``first[d]:first[d+1]`` those of document d."""

    data: np.ndarray
    doc_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word of each window of k words of one document, and the window's hash."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        doc = self.doc
        at = np.flatnonzero(doc[:n] == doc[k - 1 :])
        h = np.full(len(at), k, np.uint64) * _C
        for j in range(k):
            h = mix(h * _A + self.hashes[at + j])
        return at, h

    def text(self, word: int, k: int) -> bytes:
        """The normalised words from ``word`` on, joined by single spaces."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(word, word + k))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = end - start
    h = mix(length.astype(np.uint64) * _A + _C)
    todo, at = np.arange(len(start)), start.copy()
    while len(todo):
        left = length[todo] - (at[todo] - start[todo])
        lane = lanes[at[todo]] & _MASK[np.minimum(left, 8)]
        h[todo] = mix((h[todo] ^ lane) * _A + _B)
        todo = todo[left > 8]
        at[todo] += 8
    return h


def scan(data: np.ndarray, doc_start: np.ndarray, keep: np.ndarray, lower: bool) -> Words:
    """Words of the documents at ``doc_start[d]:doc_start[d+1]`` of ``data``."""
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, doc_start, none, none, np.zeros(len(doc_start), np.int64), np.zeros(0, np.uint64))
    inside = keep[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = doc_start[(doc_start > 0) & (doc_start < n)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, doc_start, start, end, np.searchsorted(start, doc_start), word_hashes(data, start, end))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, last row + 1, bytes, document offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, raw = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def scan_column(column: pa.Array, keep: np.ndarray = NOT_SPACE, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    for row, stop, data, doc_start in text_slices(column):
        yield row, stop, scan(data, doc_start, keep, lower)
