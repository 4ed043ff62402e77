"""TF-IDF by groups: the vocabulary is exact without a row a 2-gram, and what is shuffled doesn't grow with queries x texts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_pairs import written

from lectern.operators import postings, search, textpairs


def texts(spark, n, words=400, seed=5):
    """Frequent words, and many words and 2-grams of one text only; one in ten is a copy."""
    rng = random.Random(seed)
    made = [" ".join(rng.choices([f"w{i}" for i in range(words)], [1 / (1 + i) for i in range(words)], k=30) + [f"own{i}x{j}" for j in range(8)]) for i in range(n)]
    return spark.createDataFrame([(i, made[i - 1] if i % 10 == 9 else made[i]) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "alone")], "item_id long, text string").repartition(3)


def counted(rows):
    """(term, total, df) of the rows' tokens and pairs of neighbours, most frequent first, ties by term."""
    total, df = Counter(), Counter()
    for tokens in rows:
        each = tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]
        total.update(each)
        df.update(set(each))
    return sorted(((t, n, df[t]) for t, n in total.items()), key=lambda x: (-x[1], x[0].encode()))


@pytest.mark.parametrize("n", [1, 40, 700, 10**6])
def test_most_frequent_terms_are_exact(spark, n):
    rows = texts(spark, 300).select(search.word_tokens(F.col("text")).alias("terms"))
    wanted = counted([r.terms for r in rows.collect() if r.terms])
    assert [tuple(r) for r in search.most_frequent(rows, n).collect()] == wanted[:n]


def test_bound_falls_until_it_holds(spark, monkeypatch):
    """Slots far too few, so that each holds many terms: the first bound is too high, and it still ends with the exact terms."""
    rows = texts(spark, 300).select(search.word_tokens(F.col("text")).alias("terms"))
    asked = []
    count = postings.counting
    monkeypatch.setattr(postings, "counting", lambda slots: asked.append(1) or count(slots))

    def crowded(batches):
        for b in postings.slot_sums(batches):
            sums = b.column(1).flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(b.column(1).offsets, pa.array(np.where(sums > 0, 1_000_000, 0)))], names=["part", "sums"])

    monkeypatch.setattr(search.postings, "slot_sums", crowded)
    found = [tuple(r) for r in search.most_frequent(rows, 40).collect()]
    assert len(asked) > 2 and found == counted([r.terms for r in rows.collect() if r.terms])[:40]


@pytest.mark.parametrize("with_units", [False, True])
def test_groups_equal_the_full_scan(spark, monkeypatch, with_units):
    """With units whose query side is null for some; among copies the smaller items."""
    c = texts(spark, 260)
    q = c.where("item_id % 9 = 0 OR item_id > 255").withColumnRenamed("item_id", "query_id").unionByName(spark.createDataFrame([(-1, "nothing here"), (-2, "w1 w2 w1")], "query_id long, text string"))
    units = (F.when(F.col("query_id") % 2 == 0, F.col("query_id") % 7), F.col("item_id") % 7, 0.3) if with_units else None
    bonus = F.lit(0.0) if units is None else F.when(units[0] == units[1], 0.3).otherwise(0.0)
    final = lambda df: search.best(df.withColumn("final", F.round(F.col("score") + bonus, 4)).select("query_id", "item_id", "score", "final"), 6, score="final")
    key = lambda df: sorted((r.query_id, r.rank, r.item_id, r.score) for r in df.collect())
    every = key(final(search.tfidf(q, c, max_features=300)))
    some = search.tfidf(q, c, max_features=300, k=6, units=units)
    assert key(final(some)) == every and every
    made = textpairs.item_groups
    monkeypatch.setattr(textpairs, "item_groups", lambda docs, weigh: made(docs, weigh, 7, 100))
    assert key(final(search.tfidf(q, c, max_features=300, k=6, units=units))) == every


def test_shuffled_rows_grow_with_the_texts_not_with_pairs(spark):
    """Three times the queries and texts: with postings read as rows, and with a row a 2-gram, it was many times more."""
    rows = []
    for n in (400, 1_200):
        c = texts(spark, n, words=60).localCheckpoint()
        q = c.where("item_id % 10 = 0").withColumnRenamed("item_id", "query_id").localCheckpoint()
        before = written(spark)
        search.best(search.tfidf(q, c, max_features=200, k=5), 5).write.format("noop").mode("overwrite").save()
        rows.append(written(spark) - before)
    assert rows[1] < 4 * rows[0] and rows[1] < 100 * 1_200, rows
