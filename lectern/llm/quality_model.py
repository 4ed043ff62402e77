"""Quality by positive-unlabelled learning with the non-negative risk estimator.

A linear model on document features (shares of kinds of characters, lengths, repeated words and runs, and the shares of
hashed words) is fitted to trusted positives (documents labelled good) and to all documents as unlabelled ones, whose labels
are never read. With class prior p and sigmoid loss l, the risk minimised is

    p * mean_P l(+1) + max(0, mean_U l(-1) - p * mean_P l(-1))

and where the bracket falls below zero its gradient is turned around, so the model cannot win by overfitting the
unlabelled part.

The class prior is estimated, not counted: a first model that tells positives from unlabelled documents scores both, and
the prior is the smallest share of unlabelled documents above a threshold over that of positives above it, taken at the
threshold where its upper confidence bound is least. The first model is fitted to every other positive, the shares are
those of the rest.

Positives are a bounded sample of labelled rows: at most ``positives`` documents, chosen by the hash of their ids. The
unlabelled part has no bound: every document's features are written once, dealt to chunks by the hash of their ids and features, and each
chunk is fitted with the positives by its own task. The model is the mean of the chunks' models, weighted by their documents. All
documents are scored in a narrow stage.

Defined cases: a null text is the empty text and gets a score of its own (the model's at zero features); without positives
or without documents every score is 0.5; labels of null doc_id or null value are ignored; a doc_id with two labels is good
only if both say so; repeated rows count and are scored one by one; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.classify import pick, sigmoid, with_scores
from lectern.llm.packed import SOLID, grams, slices, words_of
from lectern.llm.text import whole
from lectern.session import cut, forget, ship

MARKS = [b"!", b".,;:", b"#$%&*", b"|<>{}[]", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"]
N_STATS, WORD_BITS = 16, 7
SIZE = 2 * N_STATS + (1 << WORD_BITS)
CLIP, BINS = 4.0, 1000


def statistics(buf: np.ndarray, at: np.ndarray, w) -> np.ndarray:
    """Shares and counts of each document, about 0 to 1 each; ``w``: its words as they stand."""
    h, first, n = w.hashes(), w.first, len(at) - 1
    doc = w.doc
    words, size = np.diff(first).astype(float), np.diff(at).astype(float)
    out = np.zeros((n, N_STATS))
    some, long = np.maximum(words, 1), np.maximum(size, 1)
    for k, bytes_ in enumerate(MARKS):
        table = np.zeros(256, bool)
        table[list(bytes_)] = True
        total = np.concatenate(([0], np.cumsum(table[buf])))
        out[:, k] = (total[at[1:]] - total[at[:-1]]) / long
    k = len(MARKS)
    out[:, k] = np.bincount(doc, weights=(w.end - w.start), minlength=n) / some / 10
    out[:, k + 1] = np.log1p(words) / 10
    out[:, k + 2] = words == 0
    out[:, k + 3] = np.exp(-words / 10)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, k + 4] = np.bincount(doc[same], minlength=n) / some
    for j, size_ in enumerate((1, 4, 8)):  # share of repeated runs of words
        g, p = grams(h, first, size_)
        d = np.searchsorted(first, p, "right") - 1
        order = np.lexsort((g, d))
        again = (g[order][1:] == g[order][:-1]) & (d[order][1:] == d[order][:-1])
        out[:, k + 5 + j] = np.bincount(d[order][1:][again], minlength=n) / some
    lone = (w.end - w.start) == 1
    out[:, k + 8] = np.bincount(doc[lone], minlength=n) / some
    return out


def features(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Statistics, their square roots, and the square roots of the shares of words by hash."""
    w = words_of(buf, at, SOLID, lower=False)
    stats = statistics(buf, at, w)
    lowered = words_of(buf, at, SOLID)
    n, bins = len(at) - 1, 1 << WORD_BITS
    cell = lowered.doc * bins + (lowered.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    held = np.bincount(cell, minlength=n * bins).reshape(n, bins) / np.maximum(np.diff(w.first), 1)[:, None]
    return np.hstack([stats, np.sqrt(stats), np.sqrt(held)]).astype(np.float32)


class Model:
    """A linear model on standardised features, each cut at CLIP standard deviations."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray, bias: float):
        self.centre, self.spread, self.weights, self.bias = centre, spread, weights, bias

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -CLIP, CLIP)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features."""
        return sigmoid(self.scaled(x) @ self.weights + self.bias)

    def scores(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.of(features(buf, at))


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of every row: its features as an array of floats."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(buf, at) for _, _, buf, at in slices(batch.column(1))]
            flat = np.concatenate(x) if x else np.zeros((0, SIZE), np.float32)
            lists = pa.ListArray.from_arrays((np.arange(len(flat) + 1) * SIZE).astype(np.int32), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole("text").alias("text")).mapInArrow(run, "doc_id string, x array<float>")


def matrix(lists) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy().reshape(-1, SIZE) if len(lists) else np.zeros((0, SIZE), np.float32)


def moments(stored: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of documents, mean and standard deviation of each feature; tasks add up their own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((2, SIZE))
        for batch in batches:
            x = matrix(pa.chunked_array([batch.column(0)])).astype(np.float64)
            n, total = n + len(x), total + np.stack([x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([n] * SIZE), pa.array(np.arange(SIZE)), pa.array(total[0]), pa.array(total[1])], names=["n", "k", "s", "q"])

    rows = stored.select("x").mapInArrow(run, "n long, k long, s double, q double").groupBy("k").agg(F.sum("n"), F.sum("s"), F.sum("q")).orderBy("k").collect()
    if not rows or not rows[0][1]:
        return 0, np.zeros(SIZE), np.ones(SIZE)
    n, s, q = rows[0][1], np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    return n, s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)) + 1e-3


def descend(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int, l2: float, rate: float) -> tuple[np.ndarray, float]:
    """Weights and bias for scaled positives and unlabelled rows, by Adam.

    With a prior the non-negative risk is minimised; l(z, +1) = sigmoid(-z), l(z, -1) = sigmoid(z). Without one
    it is the logistic loss of positives against unlabelled rows, both sides weighing the same.
    """
    w, b = np.zeros(SIZE), 0.0
    m, v = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    slope = lambda s: s * (1 - s)
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w + b), sigmoid(u @ w + b)
        if prior is None:
            gp, gu = (sp - 1) / len(sp), su / len(su)
        elif su.mean() - prior * sp.mean() >= 0:
            gp, gu = -2 * prior * slope(sp) / len(sp), slope(su) / len(su)
        else:
            gp, gu = prior * slope(sp) / len(sp), -slope(su) / len(su)
        g = np.append(p.T @ gp + u.T @ gu + l2 * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], float(b - step[-1])
    return w, b


def sample_of(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """(x) of a bounded set of ids, one row an id however many rows share it (the one with the smallest hash), in the order of their hashes."""
    found = stored.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("x", F.xxhash64("x")).alias("x"))
    return found.orderBy(F.xxhash64("doc_id"), "doc_id").select("x")


def fitted(stored: DataFrame, positives: np.ndarray, scale: Model, chunks: int, prior: float | None, steps: int, l2: float, rate: float) -> Model:
    """The mean of the models that chunks of unlabelled rows reach together with the positives (a bounded sample, broadcast)."""
    shared = stored.sparkSession.sparkContext.broadcast((scale.scaled(positives), scale))

    def run(rows: pa.Table) -> pa.Table:
        p, by = shared.value
        u = by.scaled(matrix(rows.column("x")))
        w, b = descend(p, u, prior, steps, l2, rate)
        return pa.table({"k": np.arange(SIZE + 1), "s": np.append(w, b) * len(u), "n": np.full(SIZE + 1, len(u))})

    dealt = stored.select("x", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit("")), "x"), F.lit(chunks)).alias("chunk"))
    models = dealt.groupBy("chunk").applyInArrow(run, "k long, s double, n long").groupBy("k").agg((F.sum("s") / F.sum("n")).alias("w"))
    w = np.array([r.w for r in models.orderBy("k").collect()])
    return Model(scale.centre, scale.spread, w[:-1], float(w[-1]))


def histogram(stored: DataFrame, model: Model) -> np.ndarray:
    """Numbers of documents by score, in BINS bins."""
    shared = stored.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BINS, np.int64)
        for batch in batches:
            n += binned(shared.value.of(matrix(pa.chunked_array([batch.column(0)]))))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(n)], names=["bin", "n"])

    out = np.zeros(BINS, np.int64)
    for r in stored.select("x").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r.bin] = r.n
    return out


def binned(scores: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum((scores * BINS).astype(np.int64), BINS - 1), minlength=BINS)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among unlabelled documents, from the numbers of both by score bin."""
    above = lambda n: np.cumsum(n[::-1])[::-1] / max(n.sum(), 1)
    p, u = above(positive), above(unlabelled)
    room = lambda n: math.sqrt(math.log(4 / delta) / (2 * max(n, 1)))
    bound = np.where(p > 0, (u + room(unlabelled.sum()) + (1 + gamma) * room(positive.sum())) / np.maximum(p, 1e-9), np.inf)
    at = int(np.argmin(bound))
    return float(min(max(u[at] / max(p[at], 1e-9), 0.01), 0.99))


def learn(docs: DataFrame, labels: DataFrame, positives: int = 2500, chunk_rows: int = 20_000, steps: int = 300, l2: float = 1e-3, rate: float = 0.05) -> Model:
    """Fit on the positives among ``labels`` (doc_id, quality), all of which may be learned from, and on all texts of ``docs``."""
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    ids = pick(good, positives).select(F.col("doc_id").cast("string").alias("doc_id"))
    stored = cut(featured(docs), "features")
    n, centre, spread = moments(stored)
    scale = Model(centre, spread, np.zeros(SIZE), 0.0)
    p = matrix(sample_of(stored, ids).toArrow().column("x")).astype(np.float64)
    if n and len(p):
        chunks = max(1, math.ceil(n / chunk_rows))
        first = fitted(stored, p[::2], scale, chunks, None, steps, l2, rate)
        prior = estimated_prior(binned(first.of(p[1::2] if len(p) > 1 else p)), histogram(stored, first))
        scale = fitted(stored, p, scale, chunks, prior, steps, l2, rate)
        scale.prior = prior
    forget(stored)
    return scale


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` without the text, plus the score (0 to 1)."""
    return with_scores(docs, model, text, name)
