"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams (A-Z lower-cased) of a document, hashed to 2**20 numbers. For each, r is the
log of the ratio of its smoothed shares among toxic and clean training documents; a logistic regression is then fitted
on the presences times r, and its intercept is moved from the sample's share of toxic documents to that of all
learning labels. A feature counts if ``least`` documents or more hold it and its ratio is ``least_evidence`` standard
errors or more from 0, which chance alone passes about once in 16,000 features; there is no other limit.

The model is fitted on a bounded sample of labelled rows: at most ``per_class`` documents of each class, whole texts,
chosen by the hash of their ids. Executors turn them into feature numbers and count those; the driver gets the counts (one row
a feature) and the sample's numbers. All documents are scored in a narrow stage.

Defined cases: a null text is the empty text, whose score is that of the intercept; without any toxic or any
clean learning row every score is the share of toxic rows (0 without any labels); labels of null doc_id or null value are
ignored; a doc_id with both labels counts as toxic; of learning documents that share a doc_id one is learned from;
repeated rows are scored one by one; extra columns pass through; bytes that aren't UTF-8 are characters of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.classify import Grams, distinct, pick, sampled, sigmoid, with_scores
from lectern.llm.packed import slices
from lectern.session import cut, forget, ship

SIZES, BITS = (3, 4, 5, 6), 20


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias
        self._scratch = None

    def __getstate__(self):
        at = np.flatnonzero(self.weights)
        return {"at": at.astype(np.int32), "w": self.weights[at], "bias": self.bias}

    def __setstate__(self, s):
        self.weights, self.bias, self._scratch = np.zeros(1 << BITS, np.float32), s["bias"], None
        self.weights[s["at"]] = s["w"]

    def scores(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self._scratch is None:
            self._scratch = np.zeros(1 << BITS, np.int32)
        keep = self.weights != 0
        raw = [self.weights[distinct(x, self._scratch)].sum(dtype=np.float64) for x in Grams(SIZES, BITS).documents(buf, at, keep)]
        return sigmoid(np.array(raw) + self.bias)


def features(docs: DataFrame) -> DataFrame:
    """(toxic, features) of each row of (toxic int, text string)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scratch = Grams(SIZES, BITS), np.zeros(1 << BITS, np.int32)
        for batch in batches:
            lists = [np.sort(distinct(x, scratch)) for _, _, buf, at in slices(batch.column(1)) for x in grams.documents(buf, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["toxic", "features"])

    return docs.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "toxic int, features array<int>")


def ratios(counts: np.ndarray, n: tuple[int, int], least: int, least_evidence: float, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features that count among rows of (clean documents, toxic documents) with the feature, and their log ratios."""
    q, p = counts[:, 0] + alpha, counts[:, 1] + alpha
    r = np.log((p / (n[1] + 2 * alpha)) / (q / (n[0] + 2 * alpha)))
    good = (counts.sum(1) >= least) & (np.abs(r) / np.sqrt(1 / p + 1 / q) >= least_evidence)
    return np.flatnonzero(good), r[good]


def regression(flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, scale: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on presences times ``scale``; row i holds the next sizes[i] features of ``flat``."""
    row, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    full = sizes > 0
    w, b = np.zeros(len(scale)), 0.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = np.full(len(y), b)
        z[full] += np.add.reduceat((scale * w)[flat], start[full]) if full.any() else 0
        err = (sigmoid(z) - y) / len(y)
        gw, gb = scale * np.bincount(flat, weights=err[row], minlength=len(w)) + l2 * w / len(y), err.sum()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9**t)
        w -= rate * mw / (np.sqrt(vw / (1 - 0.999**t)) + 1e-8)
        b -= rate * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return scale * w, float(b)


def fit(sample: DataFrame, share: float, least: int = 4, least_evidence: float = 4.0, alpha: float = 1.0, l2: float = 1.0, steps: int = 200) -> Model:
    """Fit on (toxic, text) rows of both classes; ``share`` is that of toxic rows outside the sample."""
    spark = sample.sparkSession
    found = cut(features(sample), "features")
    sizes = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = (sizes.get(0, 0), sizes.get(1, 0))
    if not all(n):
        forget(found)
        return Model(np.zeros(1 << BITS), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    counts = found.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.sum("toxic").alias("toxic"))
    table = counts.where(F.col("clean") + F.col("toxic") >= least).orderBy("f").toArrow()
    f = table.column("f").to_numpy()
    good, r = ratios(np.stack([table.column(c).to_numpy() for c in ("clean", "toxic")], 1).astype(np.float64), n, least, least_evidence, alpha)
    chosen = f[good]
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    shared = spark.sparkContext.broadcast(place)

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(p := shared.value[x.values.to_numpy()])[p >= 0] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["toxic", "features"])

    rows = found.mapInArrow(compact, "toxic int, features array<int>").toArrow()
    forget(found)
    lists = rows.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    y = rows.column("toxic").to_numpy().astype(np.float64)
    weights, bias = regression(lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), y, r, l2, steps)
    every = np.zeros(1 << BITS)
    every[chosen] = weights
    odds = lambda s: np.log(s / (1 - s))
    return Model(every, float(bias + odds(min(max(share, 1e-4), 1 - 1e-4)) - odds(n[1] / sum(n))))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> Model:
    """Fit on ``labels`` (doc_id, toxic), all of which may be learned from."""
    rows = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = rows.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).head()
    ids = [pick(rows.where((F.col("toxic") == 1) == (k == 1)), per_class).withColumn("toxic", F.lit(k)) for k in (1, 0)]
    return fit(sampled(docs.select("doc_id", "text"), ids[0].union(ids[1])), share=(n_toxic or 0) / max(n, 1))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` without the text, plus the score (0 to 1)."""
    return with_scores(docs, model, text, name)
