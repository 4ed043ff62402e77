"""Packed exchange of hashed n-grams: what chunks of documents ask and what buckets of keys answer.

Counting n-grams one row at a time would shuffle tens of bytes for each. Here a chunk (some MB of text) sends each
bucket (a range of hash values) one row with its sorted distinct keys, delta-coded and compressed; Spark groups the
rows by bucket, and the answers, in the order of the keys asked, by chunk. A chunk sends a key once, so a key
that every document holds is one entry a chunk in its bucket. Work is in proportion to the keys: buckets without a
key cost nothing. :func:`scale` lets chunks and buckets grow with the square root of the input, so that a message
holds at least ``MESSAGE_KEYS`` keys up to some tens of terabytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import zstandard

U = np.uint64
MESSAGE_KEYS, MOST_KEYS = 64, 32_000_000
WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def scale(keys: int, least_chunk: int, least_bucket: int) -> tuple[int, int]:
    """Keys of a chunk and number of buckets for an input of ``keys`` keys; neither holds more than MOST_KEYS."""
    root = min(MOST_KEYS, math.isqrt(MESSAGE_KEYS * max(keys, 1)))
    return max(least_chunk, root), max(4, math.ceil(keys / max(least_bucket, root)))


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes of the numbers, plane by plane, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def _expand(blob: bytes, kind) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    planes = np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys."""
    return _squeeze(np.diff(keys.astype(U), prepend=U(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_expand(blob, U), dtype=U)


def pack_counts(x: np.ndarray) -> bytes:
    """Numbers from 0 up to 2**64 - 1, in the narrowest width that holds them all (its place in WIDTHS comes first)."""
    top = int(x.max()) if len(x) else 0
    width = next(i for i, t in enumerate(WIDTHS) if top <= np.iinfo(t).max)
    return bytes([width]) + _squeeze(x.astype(WIDTHS[width]))


def unpack_counts(blob: bytes) -> np.ndarray:
    return _expand(blob[1:], WIDTHS[blob[0]])


def pack_longs(x: np.ndarray) -> bytes:
    return _squeeze(x.astype(np.int64))


def unpack_longs(blob: bytes) -> np.ndarray:
    return _expand(blob, np.int64)


def messages(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the runs of ascending ``keys`` that share a bucket (an equal range of hash values)."""
    if not len(keys):
        return
    if buckets >= 1 << 32:
        raise ValueError("too many buckets")
    bucket = ((keys >> U(32)) * U(buckets)) >> U(32)
    edge = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    starts = np.concatenate(([0], edge))
    yield from zip(bucket[starts].tolist(), starts.tolist(), [*edge.tolist(), len(keys)], strict=True)
