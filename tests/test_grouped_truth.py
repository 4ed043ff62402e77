"""Ground truths by groups: the same metrics as with their pairs, and no pairs made."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import metrics
from lectern.plans import retrieval

RANKED = [(q, (q * 7 + r * r) % 60, r) for q in range(0, 60, 5) for r in range(1, 21) if (q * 7 + r * r) % 60 != q] + [(999, 1, 1)]


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_same_metrics_as_with_pairs(spark):
    group = F.when(F.col("id") % 11 == 0, None).when(F.col("id") == 20, -1).otherwise(F.col("id") % 3)
    items = spark.range(60).select(group.alias("group"), F.col("id").alias("item_id"), (1 + F.col("id") % 3).cast("int").alias("relevance"))
    asked = items.where("item_id % 5 = 0").select(F.col("item_id").alias("query_id"), "group")
    pairs = asked.join(items, "group").where("query_id <> item_id").select("query_id", "item_id", "relevance")
    ranked = spark.createDataFrame(RANKED, "query_id long, item_id long, rank int")
    truth = metrics.same_group(asked, items)
    assert rows(metrics.per_query(ranked, truth)) == rows(metrics.per_query(ranked, pairs))
    models = ranked.withColumn("model", F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("rank") % 2 + 1).cast("int")))
    assert rows(metrics.per_query(models, truth, ("model",))) == rows(metrics.per_query(models, pairs, ("model",)))
    assert rows(truth.ids) == rows(pairs.select(F.col("query_id").alias("item_id")).union(pairs.select("item_id")).distinct())


def test_lengths_alike_are_counted_without_pairs(spark, sf, tmp_path):
    d = [(i, None if i == 17 else "s" + str(i % 2), "en", None if i % 19 == 0 else (i * i) % 97 + 300 * (i % 4)) for i in range(200)] + [(200, "alone", "en", 5), (220, "s0", "en", 0), (240, "s0", "en", 0)]
    spark.createDataFrame(d, "doc_id long, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(x[0],) for x in d], "vec_id long").write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted, named = {}, set()
    for a, s, _, n in d:
        if a % 20 == 0:
            like = [3 if m is not None and n is not None and abs(n - m) * 2 <= n else 1 for b, t, _, m in d if b != a and s is not None and t == s]
            if like:
                named |= {b for b, t, *_ in d if t == s}
                wanted[a] = (len(like), sorted(like, reverse=True)[:20])
    for width in (7, 256):
        truth = retrieval.same_source(spark, str(tmp_path), width)
        assert {r.query_id: (r.n_rel, r.best) for r in truth.wanted.collect()} == wanted
    assert {r.item_id for r in truth.ids.collect()} == named


@pytest.mark.parametrize("n", [1_000, 4_000])
def test_rows_stay_in_proportion(spark, n):
    items = spark.range(n).select(F.lit(1).alias("group"), F.col("id").alias("item_id"), F.lit(1).alias("relevance"))
    truth = metrics.same_group(items.select(F.col("item_id").alias("query_id"), "group"), items)
    first = truth.wanted.agg(F.count("*"), F.max(F.size("best")), F.min("n_rel")).head()
    assert tuple(first) == (n, max(metrics.CUTS), n - 1)
