"""Auto ground truth by groups: units count for ranking only, copies give few rows, and what is shuffled doesn't grow with queries x texts."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_lexical_groups import texts
from test_text_pairs import written

from lectern.operators import groundtruth as gt
from lectern.operators import search, textpairs


def test_a_group_of_copies_gives_few_rows():
    n, k = 2_000, 5
    asked = pa.array([{"query_id": -1, "terms": [7], "weights": [1.0], "unit": 3}], pa.struct([("query_id", pa.int64()), ("terms", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("unit", pa.int64())]))
    lists = np.arange(n), np.array([7]), np.array([n], np.int32), np.arange(n, dtype=np.int32), np.full(n, 0.5)
    (out,) = textpairs.lead(asked, k, 0.1, pa.array([3, None] * (n // 2), pa.int64()), *lists)
    assert out.column("item_id").to_pylist() == [0, 2, 4, 6, 8]


def test_shuffled_rows_grow_with_the_texts_not_with_pairs(spark):
    """Three times the queries and texts; a unit was one more term, whose postings and those of frequent terms were rows to shuffle."""
    rows = []
    for n in (400, 1_200):
        c = texts(spark, n, words=60).localCheckpoint()
        q = c.where("item_id % 10 = 0").withColumnRenamed("item_id", "query_id").localCheckpoint()
        units = F.col("query_id") % 10, F.col("item_id") % 10
        before = written(spark)
        found = search.tfidf(q, c, max_features=200, k=5, units=(*units, 0.12 / 0.7))
        gt.auto_truth(found.withColumn("meta", F.when(units[0] == units[1], 0.4).otherwise(0.0))).write.format("noop").mode("overwrite").save()
        rows.append(written(spark) - before)
    assert rows[1] < 4 * rows[0] and rows[1] < 100 * 1_200, rows
