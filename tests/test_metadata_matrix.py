"""Metadata similarity has every document with every other one, whatever they have in common and however large a class is."""

import pytest

from lectern.operators import groundtruth as gt
from lectern.plans import catalog

COLUMNS = "item_id long, unit_small string, unit_medium string, unit_large string, difficulty string"


@pytest.mark.parametrize("side", [gt.SIDE, 7])
def test_all_pairs_both_ways(spark, side):
    rows = [(i, [None, "", "s1", "s2"][i % 4], ["a", "b", None][i % 3], str(i % 2), "0") for i in range(30)] + [(i, "hot", "hot", "hot", "hot") for i in range(50, 80)] + [(40, None, None, "", None)]
    found = gt.metadata_matrix(spark.createDataFrame(rows, COLUMNS), side).collect()
    wanted = {}
    for a, *x in rows:
        for b, *y in rows:
            if a != b:
                wanted[a, b] = round(sum(w for u, v, w in zip(x, y, (0.4, 0.3, 0.2, 0.1), strict=True) if u and u == v), 6)
    assert len(found) == len(wanted) and {(r.x, r.y): r.score for r in found} == wanted and 0 in wanted.values()


def test_the_query_gives_pairs_of_documents(spark, sf):
    found = catalog.QUERIES["r5_metadata_similarity"](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert found.count() == n * (n - 1) and found.where("score = 0").count() > 0


def test_a_large_class_is_dealt_and_no_pair_is_shuffled(spark):
    items = spark.range(3_000).selectExpr("id AS item_id", "'s' AS unit_small", "'m' AS unit_medium", "'l' AS unit_large", "'d' AS difficulty")
    found = gt.metadata_matrix(items, 500)
    sizes = [r.n for r in found.groupBy("x").count().selectExpr("count AS n").distinct().collect()]
    each = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sizes == [2_999] and max(each) < 3_000 * 2_999 / 4 and "CartesianProduct" in found._jdf.queryExecution().toString()
