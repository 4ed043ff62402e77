"""The two classifiers' learning against plain Python, bounds on what is collected, and independence of how files are split."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import classify, quality_model, toxicity


def test_positives_are_one_row_an_id(spark):
    """Six thousand rows of one id are one positive; a document of two texts gives one of them, the same each time."""
    rows = [("1", f"text number {i}") for i in range(6_000)] + [(str(i), f"text {i}") for i in range(2, 40)]
    stored = quality_model.featured(spark.createDataFrame(rows, "doc_id string, text string")).cache()
    ids = spark.createDataFrame([(str(i),) for i in range(1, 30)], "doc_id string")
    found = quality_model.sample_of(stored, ids)
    assert found.count() == 29
    again = quality_model.sample_of(stored.repartition(7), ids)
    assert [r.x for r in found.collect()] == [r.x for r in again.collect()]


def test_model_doesnt_depend_on_files(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, None)], labels.schema))
    one, many = (quality_model.learn(docs.repartition(n), labels, chunk_rows=70, steps=40) for n in (1, 7))
    assert np.allclose(one.weights, many.weights, atol=1e-6) and one.prior == pytest.approx(many.prior, abs=1e-6)


def plain_risk(w, b, p, u, prior):
    s = lambda x: 1 / (1 + math.exp(-(sum(a * c for a, c in zip(w, x, strict=True)) + b)))
    mean = lambda xs: sum(xs) / len(xs)
    return prior * mean([1 - s(x) for x in p]), mean([s(x) for x in u]) - prior * mean([s(x) for x in p])


@pytest.mark.parametrize("shift", [1.0, -3.0])  # with the second, the bracket is negative at first
def test_first_step_follows_the_plain_risk(shift):
    """The first step of the optimiser goes against the gradient of the risk, or turns around where the bracket is negative."""
    rng = np.random.default_rng(4)
    p, u, prior = rng.normal(size=(30, 4)) + 0.5, rng.normal(size=(50, 4)) * 0.3 + 0.2 * shift, 0.9
    wide = lambda x: np.hstack([x, np.zeros((len(x), quality_model.SIZE - 4))])
    w, b = quality_model.descend(wide(p), wide(u), prior, 1, 0.0, 0.01)
    flat = [0.0] * 4
    down = plain_risk(flat, 0.0, p, u, prior)[1] < 0

    def value(w, b):
        good, rest = plain_risk(w, b, p, u, prior)
        return -rest if down else good + rest

    for i in range(4):
        step = [1e-5 if j == i else 0.0 for j in range(4)]
        slope = (value(step, 0.0) - value([-x for x in step], 0.0)) / 2e-5
        assert w[i] == pytest.approx(-0.01 * math.copysign(1, slope), rel=1e-3)


def test_toxicity_learns_what_plain_python_learns(spark):
    """Chosen features, their log ratios and the first step of the regression, from sets of character n-grams."""
    rng = random.Random(6)
    clean, bad = ["lake", "river", "stone", "cloud", "field"], ["zounds", "vile", "wretch"]
    rows = [(i, " ".join(rng.choices(clean, k=12) + (rng.choices(bad, k=3) if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(400)]
    sample = spark.createDataFrame([(t, x) for _, x, t in rows], "toxic int, text string")
    model = toxicity.fit(sample, share=1 / 3, steps=1)
    sets = [{x[i : i + n] for n in toxicity.SIZES for i in range(len(x) - n + 1)} for _, x, _ in rows]
    grams = classify.Grams(toxicity.SIZES, toxicity.BITS)

    def number(gram):
        raw = np.frombuffer(gram.encode(), np.uint8)
        return int(next(grams.documents(raw, np.array([0, len(raw)])))[-1])  # the longest n-gram of a text that is one

    n = [sum(t == k for *_, t in rows) for k in (0, 1)]
    chosen = {}
    for gram in set().union(*sets):
        q, p = (sum(gram in s and t == k for s, (_, _, t) in zip(sets, rows, strict=True)) for k in (0, 1))
        r = math.log(((p + 1) / (n[1] + 2)) / ((q + 1) / (n[0] + 2)))
        if p + q >= 4 and abs(r) / math.sqrt(1 / (p + 1) + 1 / (q + 1)) >= 4:
            slope = sum((0.5 - t) * r for s, (_, _, t) in zip(sets, rows, strict=True) if gram in s)
            chosen[number(gram)] = (r, -0.05 * math.copysign(1, slope))
    assert set(np.flatnonzero(model.weights).tolist()) == set(chosen) and len(chosen) > 20
    for at, (r, w) in chosen.items():
        assert model.weights[at] == pytest.approx(r * w, rel=1e-3)


def test_repeated_rows_null_labels_and_long_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_001, "word " * 1_000_000), (10_002, None), (10_003, "")], "doc_id long, text string")
    docs = docs.unionByName(docs.limit(20)).unionByName(more)
    for module, label in ((toxicity, "toxic"), (quality_model, "quality")):
        labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.when(F.col("doc_id") % 11 > 0, F.col(label)).alias(label))
        scored = module.score(docs, module.learn(docs, labels.unionByName(labels)))
        assert scored.count() == docs.count()
        assert scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
        assert scored.where("doc_id IN (10002, 10003)").select("score").distinct().count() == 1
