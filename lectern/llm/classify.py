"""What the two text classifiers share: bounded samples of labelled rows, character n-grams and scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.packed import LOWERED, slices
from lectern.llm.text import whole
from lectern.session import ship

U = np.uint64


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def pick(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` distinct doc_ids of ``rows``, by the order of their hashes: the same for the same rows."""
    return rows.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(n)


def sampled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of a bounded set of ids, one row an id, with their other columns. The ids are broadcast: :func:`pick` bounds them."""
    found = docs.join(F.broadcast(ids), "doc_id").withColumn("text", whole("text"))
    return found.groupBy("doc_id").agg(F.min_by(F.struct([c for c in found.columns if c != "doc_id"]), F.xxhash64("text")).alias("s")).select("doc_id", "s.*")


class Grams:
    """Hashed character n-grams: a character is a UTF-8 sequence, A-Z lower-cased if asked."""

    def __init__(self, sizes: tuple[int, ...], bits: int, lower: bool = True):
        self.sizes, self.bits, self.lower = sizes, bits, lower

    def characters(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each character (its bytes), and the character at which each document starts."""
        b = LOWERED[buf] if self.lower else buf
        first = (b & 0xC0) != 0x80
        first[at[:-1][at[:-1] < len(b)]] = True  # a stray byte at the start of a document is a character of its own
        start = np.flatnonzero(first)
        if len(start) == len(b):
            return b.astype(U), at
        size, out = np.minimum(np.diff(start, append=len(b)), 4), b[start].astype(U)
        for i in range(1, 4):
            longer = np.flatnonzero(size > i)
            out[longer] |= b[start[longer] + i].astype(U) << U(8 * i)
        return out, np.searchsorted(start, at)

    def hashes(self, chars: np.ndarray) -> list[np.ndarray]:
        """For each size, the feature number of the n-gram that starts at each character."""
        out, h, n = [], np.zeros(len(chars), U), 0
        for size in self.sizes:
            while n < size:
                h = (h[: len(chars) - n] * U(0x9E3779B97F4A7C15) + chars[n:] + U(1)) if len(chars) > n else h[:0]
                n += 1
            mixed = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9 + 2 * size)
            out.append((mixed >> U(64 - self.bits)).astype(np.int32))
        return out

    def documents(self, buf: np.ndarray, at: np.ndarray, keep: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Features of each document, repeats included; only those in ``keep`` if given."""
        chars, at = self.characters(buf, at)
        every = self.hashes(chars)
        flags = None if keep is None else [keep[h] for h in every]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            parts = []
            for k, (size, h) in enumerate(zip(self.sizes, every, strict=True)):
                if b - size + 1 > a:
                    part = h[a : b - size + 1]
                    parts.append(part if flags is None else part[flags[k][a : b - size + 1]])
            yield np.concatenate(parts) if parts else np.zeros(0, np.int32)


def distinct(x: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Distinct numbers of ``x``; ``scratch`` is an array with a place for each number."""
    order = np.arange(len(x), dtype=scratch.dtype)
    scratch[x] = order
    return x[scratch[x] == order]


def with_scores(docs: DataFrame, model, text: str, name: str) -> DataFrame:
    """``docs`` with the text replaced by ``model.scores`` of it; the model (a bounded table) is broadcast."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            parts = [shared.value.scores(buf, at) for _, _, buf, at in slices(column)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in kept], pa.array(scores, pa.float64())], names=[*[f.name for f in kept], name])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
