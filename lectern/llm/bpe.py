"""Byte-level BPE encoding and decoding with a pair occurrence index.

Pre-tokens that a slice of a partition holds and the worker has not met are encoded together: their bytes form one
linked list of symbols, an index maps every mergeable pair to all its positions there, and the ranks that occur
are taken in ascending order. A merge rewrites all positions of its pair and updates the lists of the pairs
that appear beside them; positions that went stale are recognised by their symbols. Texts are then assembled
from the pre-tokens' ids. Both directions are narrow stages over Arrow batches.

The vocabulary is a ``tokenizers`` JSON file of the byte-level kind (about 50,000 tokens; its tables are
broadcast, and :func:`load` refuses more than MAX_TOKENS). Special tokens in a text count as such.

Defined cases: null counts as the empty text, which has no ids and decodes to the empty text; ids that
aren't in the vocabulary decode to nothing; bytes that aren't UTF-8, in a text or decoded from ids, count as U+FFFD; repeated rows are encoded
one by one; extra columns pass through.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm.packed import slices
from lectern.session import ship

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_TOKENS = 2_000_000
CACHED = 300_000


def _printable() -> dict[str, int]:
    """The printable stand-in of each byte: bytes that print stand for themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and tokens, with a cache of the pre-tokens met so far."""

    def __init__(self, merges: list[tuple[int, int, int]], tokens: dict[int, bytes], special: dict[str, int]):
        self.merges, self.tokens, self.special = merges, tokens, special

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("merges", "tokens", "special")}

    @cached_property
    def rank(self) -> dict[int, int]:
        """Rank by pair, the pair as one number. Of equal pairs the last merge counts."""
        return {a << 32 | b: r for r, (a, b, _) in enumerate(self.merges)}

    @cached_property
    def of_byte(self) -> list[int]:
        single = {t[0]: i for i, t in self.tokens.items() if len(t) == 1 and i not in self.special.values()}
        return [single[b] for b in range(256)]

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes in one array, and each token's place and length in it."""
        n = max(self.tokens) + 1
        size = np.array([len(self.tokens.get(i, b"")) for i in range(n)], dtype=np.int64)
        return np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(n)), dtype=np.uint8), np.cumsum(size) - size, size

    @cached_property
    def split(self):
        names = sorted(self.special, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    @cached_property
    def cache(self) -> dict[str, int]:
        """Numbers of the pre-tokens met so far; ``pieces`` has their ids. Special tokens are always there."""
        self.pieces = (array("i"), array("q", [0]))
        found = {}
        for name, i in self.special.items():
            found[name] = len(found)
            self.pieces[0].append(i)
            self.pieces[1].append(len(self.pieces[0]))
        return found

    def encode_new(self, pieces: Iterable[str]) -> None:
        """Merge all of ``pieces`` at once and put their ids into the cache."""
        pieces, rank, merges = list(pieces), self.rank, self.merges
        sym: list[int] = []
        after: list[int] = []
        heads: list[int] = []
        for p in pieces:
            heads.append(len(sym))
            sym.extend(map(self.of_byte.__getitem__, p.encode("utf-8", "surrogatepass")))
            after.extend(range(len(after) + 1, len(sym)))
            after.append(-1)
        before = [-1] * len(sym)
        where: dict[int, list[int]] = {}
        for i, j in enumerate(after):
            if j >= 0:
                before[j] = i
                if (r := rank.get(sym[i] << 32 | sym[j])) is not None:
                    where.setdefault(r, []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            left, right, new = merges[r]
            for i in sorted(where.pop(r)):
                j = after[i]
                if sym[i] != left or j < 0 or sym[j] != right:
                    continue
                k, h = after[j], before[i]
                sym[i], sym[j], after[i] = new, -1, k
                if k >= 0:
                    before[k] = i
                    if (x := rank.get(new << 32 | sym[k])) is not None:
                        if x not in where:
                            where[x] = []
                            heapq.heappush(active, x)
                        where[x].append(i)
                if h >= 0 and (x := rank.get(sym[h] << 32 | new)) is not None:
                    if x not in where:
                        where[x] = []
                        heapq.heappush(active, x)
                    where[x].append(h)
        heads.append(len(sym))
        ids, ends = self.pieces
        for p, a, b in zip(pieces, heads, heads[1:], strict=False):
            self.cache[p] = len(self.cache)
            ids.extend(s for s in sym[a:b] if s >= 0)
            ends.append(len(ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in one array, and where each text starts in it."""
        find, pieces, counts = _find(), [], []
        for t in texts:
            before = len(pieces)
            if self.split is not None and any(s in t for s in self.special):
                for x in self.split.split(t):
                    pieces.extend([x] if x in self.special else find(x))
            else:
                pieces.extend(find(t))
            counts.append(len(pieces) - before)
        if len(self.cache) > CACHED:
            del self.cache
        if new := set(pieces).difference(self.cache):
            self.encode_new(new)
        n = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        ids, bounds = np.array(self.pieces[0], dtype=np.int32), np.array(self.pieces[1], dtype=np.int64)
        flat, ends = gather(ids, bounds[:-1], np.diff(bounds), n)
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return flat, at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the texts whose ids start at ``at``, and where each text starts in them."""
        data, place, size = self.table
        known = (ids >= 0) & (ids < len(size))
        ids = np.where(known, ids, 0)
        length = np.where(known, size[ids], 0)
        flat, ends = gather(data, place[ids], length, np.arange(len(ids)))
        return flat, np.concatenate(([0], ends))[at]


_found = []


def _find():
    if not _found:
        _found.append(regex.compile(PATTERN).findall)
    return _found[0]


def gather(data: np.ndarray, place: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``data[place[i] : place[i] + size[i]]`` for i in ``which``, one after the other, and where each ends."""
    n = size[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(place[which] - (ends - n), n) + np.arange(total)], ends


def load(path: str) -> Vocabulary:
    """A vocabulary from a ``tokenizers`` JSON file, read in the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    ids, byte = model["vocab"], _printable()
    if len(ids) > MAX_TOKENS:
        raise ValueError("the vocabulary is too large to broadcast")
    if spec.get("normalizer") or model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError("not a plain byte-level BPE")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    tokens = {i: bytes(byte[c] for c in t) for t, i in ids.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens |= {i: t.encode() for t, i in special.items()}
    return Vocabulary([(ids[a], ids[b], ids[a + b]) for a, b in pairs], tokens, special)


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    raw = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """``docs`` plus the ids of each whole text (array<int>), and plus what they decode to if ``decoded`` names that column.

    Every slice of about a megabyte becomes a batch of its own, so a worker holds one slice's ids at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    kept = [f for f in docs.schema if f.name not in (ids, decoded) and (keep_text or f.name != text)]
    names = [*[f.name for f in kept], ids, *([decoded] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            for i, j, buf, at in slices(batch.column(batch.schema.get_field_index(text))):
                raw = buf.tobytes()
                flat, starts = shared.value.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)])
                new = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat, pa.int32()))]
                if decoded:
                    new.append(_strings(*shared.value.decode(flat, starts)))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in old], *new], names=names)
        pa.default_memory_pool().release_unused()

    more = [T.StructField(decoded, T.StringType())] if decoded else []
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())), *more]))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` plus the text of each list of ids."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    kept = [f for f in rows.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            column = batch.column(batch.schema.get_field_index(ids))
            for i in range(0, len(column), 256):
                part = column.slice(i, 256).fill_null([])
                flat = part.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                at = np.concatenate(([0], np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))))
                parts.append(_strings(*shared.value.decode(flat, at)))
            out = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in kept], out], names=[*[f.name for f in kept], text])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField(text, T.StringType())]))
