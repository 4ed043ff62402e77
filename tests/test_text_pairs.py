"""Whole texts against whole texts: equal to a full scan, and nothing is shuffled a posting."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import postings, search, textpairs

WORDS = [f"w{i}" for i in range(60)]


def texts(spark, n, seed=5):
    """Texts of which each holds most frequent words, and some a word of their own; one in ten is a copy."""
    rng = random.Random(seed)
    made = [" ".join(rng.choices(WORDS, [1 / (1 + i) for i in range(60)], k=40) + [f"own{i}"] * (i % 3)) for i in range(n)]
    return spark.createDataFrame([(i, made[i - 1] if i % 10 == 9 else made[i]) for i in range(n)], "item_id long, text string").repartition(3)


def sides(spark, n):
    c = texts(spark, n).unionByName(spark.createDataFrame([(n, None), (n + 1, ""), (n + 2, "alone"), (n + 3, "w0 " * 300)], "item_id long, text string"))
    q = c.where(f"item_id % 20 = 0 OR item_id >= {n}").withColumnRenamed("item_id", "query_id")
    wanted = q.crossJoin(c.select("item_id")).where("(query_id + item_id) % 7 = 0 AND query_id <> item_id").select("query_id", "item_id")
    return c, q.unionByName(spark.createDataFrame([(-1, "nothing here"), (-2, "w1 own4")], "query_id long, text string")), wanted


def written(spark):
    """Rows that stages have shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    doubles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, doubles, spark._jvm.java.util.ArrayList()))
    return sum(s.shuffleWriteRecords() for s in stages)


def test_pairs_and_best_equal_the_full_scan(spark):
    c, q, wanted = sides(spark, 200)
    every = search.bm25(q, c)
    some = every.join(wanted, ["query_id", "item_id"], "left_semi").unionByName(search.best(every, 1).drop("rank")).distinct()
    key = lambda df: sorted((r.query_id, r.item_id, r.score) for r in df.collect())
    got = key(search.bm25(q, c, wanted=wanted))
    assert got == key(some) and len(got) > 300


@pytest.mark.parametrize("often", [0.1, 8, 10**9])
def test_groups_pieces_and_matrix_dont_matter(spark, monkeypatch, often):
    """Many small groups and pieces; all terms in the matrix, none, and some. ``meet`` is called here, as workers have their own module."""
    c, q, wanted = sides(spark, 200)
    docs = search._hashed(c, "item_id", search.word_tokens)
    asked = search._weighted(q, textpairs.frequencies(textpairs.item_groups(docs, postings.Bm25(40.0))), 204, search.word_tokens)
    got = {}
    for items, terms, scores in ((textpairs.ITEMS, textpairs.TERMS, textpairs.SCORES), (7, 50, 90)):
        monkeypatch.setattr(textpairs, "OFTEN", often)
        monkeypatch.setattr(textpairs, "SCORES", scores)
        groups = textpairs.item_groups(docs.coalesce(1), postings.Bm25(40.0), items, 20 * items).toArrow()
        queries = textpairs.query_groups(asked, wanted, terms).toArrow()
        rows = []
        for a in queries.to_batches():
            for i in range(a.num_rows):
                for b in groups.to_batches():
                    for j in range(b.num_rows):
                        for out in textpairs.meet(a.column(0).slice(i, 1).flatten(), *(b.column(k).slice(j, 1).flatten().to_numpy() for k in range(5))):
                            assert out.num_rows <= 2 * len(WORDS) + scores
                            rows += out.to_pylist()
        best = {}
        for r in rows:
            best[r["query_id"]] = min(best.get(r["query_id"], (0, 0)), (-r["score"], r["item_id"]))
        got[items] = {(r["query_id"], r["item_id"]): r["score"] for r in rows if r["wanted"]}, best, groups.num_rows, queries.num_rows
    a, b = got.values()
    assert a[:2] == b[:2] and a[0] and b[2] > 25 and b[3] > 3


def test_shuffled_rows_grow_with_the_texts_not_with_pairs(spark):
    """Three times the queries and items; with a row shuffled for each posting read, rows grew with their product."""
    rows = []
    for n in (400, 1_200):
        c, q, wanted = sides(spark, n)
        wanted = wanted.where("item_id % 97 < 3").limit(5)
        c, q, wanted = (df.localCheckpoint() for df in (c, q, wanted))
        before = written(spark)
        search.bm25(q, c, wanted=wanted).write.format("noop").mode("overwrite").save()
        rows.append(written(spark) - before)
    assert rows[1] < 4 * rows[0], rows


def test_no_texts(spark):
    c, q, wanted = sides(spark, 40)
    assert search.bm25(q.limit(0), c, wanted=wanted).count() == 0 and search.bm25(q, c.limit(0), wanted=wanted).count() == 0
    assert search.bm25(q, c, wanted=wanted.limit(0)).groupBy("query_id").count().agg(F.max("count")).head()[0] == 1
