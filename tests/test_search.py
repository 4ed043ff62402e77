"""Postings, cells and inverted files: equal to plain scans, with less work."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import cells, postings, search

TEXT = "query_id long, text string"


def corpus(spark, n, seed=1, words=400):
    """Texts of Zipf-like words, a tenth of them with words of their own topic."""
    rng = random.Random(seed)
    common = [f"w{int(words * rng.random() ** 3)}" for _ in range(50 * words)]
    rows = [(i, " ".join(rng.choices(common, k=30) + [f"t{i % (n // 10)}"] * (i % 3))) for i in range(n)]
    return spark.createDataFrame(rows, "item_id long, text string").repartition(6)


def asked(spark, n, rare):
    return spark.createDataFrame([(-1 - i, f"w1 w2 w5 w{20 + i} t{i} t{i}" if rare else f"w{i} w{i + 1} w2") for i in range(n)], TEXT)


def ranked(df, k):
    return sorted((r.query_id, r.rank, r.item_id, r.score) for r in search.best(df, k).collect())


@pytest.mark.parametrize("rare", [True, False])
@pytest.mark.parametrize("scores", [search.bm25, search.tfidf])
def test_top_k_equals_the_full_scan(spark, scores, rare):
    c, q = corpus(spark, 600).coalesce(2), asked(spark, 12, rare)
    q = q.unionByName(spark.createDataFrame([(5, "w1 w2 w3"), (-90, ""), (-91, None), (-92, "nothing here")], TEXT))  # 5 is an item too
    assert ranked(scores(q, c, k=4), 4) == ranked(scores(q, c), 4)


def test_nothing_to_search(spark):
    c, q = corpus(spark, 20), asked(spark, 2, True)
    for scores in (search.bm25, search.tfidf):
        assert scores(q.limit(0), c, k=3).count() == 0 and scores(q, c.limit(0), k=3).count() == 0


def test_first_reading_doesnt_matter(spark):
    """Bounds from few or many postings give the same result."""
    c, q = corpus(spark, 500), asked(spark, 8, True)
    index, n = search.bm25_index(c)
    weights = search.bm25_asked(q, index, n)
    found = [ranked(postings.top_k(index, weights, 3, first=first), 3) for first in (1, 50, 100_000)]
    assert found[0] == found[1] == found[2] and found[0]


def test_work_grows_less_than_the_corpus(spark):
    """Ten times the documents: what a query reads grows much less, and most blocks are never read."""
    share, read = [], []
    for n in (2_000, 20_000):
        index, count = search.bm25_index(corpus(spark, n))
        done = postings.work(index, search.bm25_asked(asked(spark, 10, True), index, count), 3).agg(F.sum("postings"), F.sum("postings_read"), F.sum("blocks"), F.sum("blocks_read")).head()
        share.append(done[1] / done[0])
        read.append(done[1])
        postings.drop(index)
    assert read[1] < 5 * read[0] and share[1] < 0.25


def test_units_rank_but_dont_score(spark):
    c, q = corpus(spark, 300), asked(spark, 6, True)
    units = F.col("query_id") % 7, -(F.col("item_id") % 7)
    found = search.tfidf(q, c, k=3, units=(*units, 0.3))
    final = lambda df: search.best(df.withColumn("score", F.round(F.col("score") + F.when(units[0] == units[1], 0.3).otherwise(0.0), 6)), 3)
    key = lambda df: sorted((r.query_id, r.rank, r.item_id, r.score) for r in df.collect())
    assert key(final(found)) == key(final(search.tfidf(q, c)))


def test_a_term_of_every_document_is_spread(spark):
    index, _ = search.bm25_index(spark.range(4_000).select(F.col("id").alias("item_id"), F.concat(F.lit("the word "), F.col("id").cast("string")).alias("text")).repartition(16))
    most = index.blocks.groupBy("term").agg(F.countDistinct("cell").alias("cells"), F.sum("n").alias("n")).where("n = 4000").collect()
    assert len(most) == 2 and all(r.cells >= postings.SPREAD - 2 for r in most)


VECTOR = "item_id long, embedding array<double>"


def clustered(spark, n, spread, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16))
    x = centres[np.arange(n) % 20] + spread * rng.normal(size=(n, 16))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTOR).repartition(5), x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_nearest_equals_numpy(spark, spread):
    c, x = clustered(spark, 800, spread)
    q = c.where("item_id % 40 = 0").withColumnRenamed("item_id", "query_id")
    for sizes in ({}, {"pivots": 30, "block": 2, "group": 15}):
        got = {}
        for r in search.knn(q, c, 5, **sizes).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.item_id, r.score)
        for i in range(0, 800, 40):
            s = np.round(x @ x[i], 6)
            s[i] = -2
            order = np.lexsort((np.arange(800), -s))[:5]
            assert [got[i][k + 1][1] for k in range(5)] == pytest.approx(s[order].tolist(), abs=2e-6)
    near = search.knn(q, c, 5, threshold=0.5, pivots=30)
    assert near.count() == search.knn(q, c, 5).where("score >= 0.5").count()


def test_bounds_skip_cells_of_clustered_vectors(spark):
    c, _ = clustered(spark, 2_000, 0.05)
    q = c.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "embedding", F.lit(0.95).alias("least"))
    dealt = cells.deal(c, cells.sampled(c, 60))
    first, second = cells.visits(q, dealt, 5).count(), cells.visits(q, dealt, 5, again=True).count()
    assert first + second < 0.25 * len(dealt.known) * q.count()


def test_plan_doesnt_grow_with_queries(spark):
    c, _ = clustered(spark, 400, 1.0)
    size = lambda n: len(search.knn(c.where(f"item_id < {n}").withColumnRenamed("item_id", "query_id"), c, 3, block=4)._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(4) == size(200)


def test_vectors_without_a_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [None, 1.0]), (7, [-1.0, 0.0]), (8, [])]
    c = spark.createDataFrame(rows, VECTOR)
    q = c.withColumnRenamed("item_id", "query_id")
    for found in (search.knn(q, c, 5), search.cosine_pairs(q, c)):
        assert {(r.query_id, r.item_id): r.score for r in found.collect()} == {(1, 2): 0.0, (2, 1): 0.0, (1, 7): -1.0, (7, 1): -1.0, (2, 7): 0.0, (7, 2): 0.0}


def test_inverted_file(spark):
    c, x = clustered(spark, 3_000, 0.8)
    q = c.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    index = cells.invert(c, cells.fit(c, cells=40, pieces=8, sample=1_000))
    assert index.codes.count() == 3_000 and index.codes.where("length(code) = 8").count() == 3_000
    exact = {(r.query_id, r.item_id) for r in search.knn(q, c, 10).collect()}
    recall, seen = [], []
    for probes in (2, 8):
        found = cells.probe(q, index, 10, probes=probes).collect()
        recall.append(len(exact & {(r.query_id, r.item_id) for r in found}) / len(exact))
        seen.append(sum({r.query_id: r.seen for r in found}.values()) / 60)
    assert recall[1] >= 0.9 and recall[0] <= recall[1] and seen[0] < seen[1] < 0.5 * 3_000


def test_keywords_are_searched_in_distinct_runs(spark):
    """A word a text holds many times, over batches, is in the table of runs once a batch and item; hits over line breaks are found."""
    from lectern.operators import substrings

    texts = [(i, ("the cat\nsat " * 50) + ("Rare" if i % 7 == 3 else "")) for i in range(40)] + [(50, None), (51, ""), (52, "100% x_y")]
    items = spark.createDataFrame(texts, "item_id long, text string").repartition(3)
    assert substrings.runs(items.where("text IS NOT NULL"), 2).count() <= 2 * 3 * 7
    words = ["at\nsa", "THE", "rar", "", "0%", "cat sat", "t", "nothing", "\n", "t s"]
    got = {}
    for r in search.keywords(items, spark.createDataFrame([(w,) for w in words], "word string"), 3).collect():
        got.setdefault(r.word, []).append(r.item_id)
    assert {w: sorted(x) for w, x in got.items()} == {"at\nsa": [0, 1, 2], "THE": [0, 1, 2], "rar": [3, 10, 17], "": [0, 1, 2], "0%": [52], "t": [0, 1, 2], "\n": [0, 1, 2]}


def test_lists_are_read_in_pieces(spark):
    """Runs of rows within the bound, every row once; long rows alone."""
    import pyarrow as pa

    lists = pa.array([[1] * n for n in (3, 4, 0, 20, 1, 0)] + [None])
    assert list(postings.pieces(lists, most=7)) == [(0, 3), (3, 1), (4, 3)]
    assert list(postings.pieces(lists.slice(0, 0))) == []
