"""Vectorised helpers on Arrow text batches: words, hashes and k-grams as numpy arrays.

Everything works on the UTF-8 bytes of a slice of documents at once; no per-word Python objects are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Odd multipliers of the places of a k-gram, from the 64-bit golden ratio.
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ (i << 33)) & ((1 << 64) - 1) | 1 for i in range(64)], dtype=U)
SLICE_BYTES = 1 << 20

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Bytes of words ``[^\x20\x09-\x0D]+``.
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased; bytes of longer code points all belong.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        both = []
        for p in (BASE, INVERSE):
            a = np.full(size, p, dtype=U)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        if size > 8 * SLICE_BYTES:  # a giant document's tables aren't kept
            return both[0], both[1]
        _powers[:] = both
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a slice of documents."""

    buf: np.ndarray  # bytes of the slice, A-Z lower-cased if asked
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    first: np.ndarray  # word number at which each document starts, and the number of words at last

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words' bytes."""
        up, down = _upto(len(self.buf))
        sums = np.zeros(len(self.buf) + 1, dtype=U)
        np.cumsum((self.buf.astype(U) + U(1)) * up[: len(self.buf)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(h + (self.end - self.start).astype(U) * U(0xD6E8FEB86659FD93))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, joined by single spaces."""
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of about ``size`` bytes each; a longer document is one slice."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words_of(buf: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool = True) -> Words:
    """The words (runs of bytes of ``kind``) of each document."""
    buf = LOWERED[buf] if lower else buf
    inside = kind[buf]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(buf):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = at[(at > 0) & (at < len(buf))]
        before[edges], after[edges - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    return Words(buf, start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, at))


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one document, and the word number at which each starts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = h[:n] * PLACES[0]
    for i in range(1, k):
        g = g + h[i : i + n] * PLACES[i]
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))  # words left in the document
    at = np.flatnonzero(left[:n] >= k)
    return mix(g[at]), at
