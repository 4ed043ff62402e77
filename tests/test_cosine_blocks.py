"""All pairs of vectors: nothing of a pair is shuffled, blocks are bounded, and the files of the result are small."""

import numpy as np
import pytest
from test_text_pairs import written

from lectern.operators import cells, search

VECTOR = "{} long, embedding array<double>"


def sides(spark, n, parts=5, dim=8):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(n, dim)), 3)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTOR.format("item_id")).repartition(parts)
    return c.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id"), c, x


@pytest.mark.parametrize("block, group", [(cells.BLOCK, cells.BLOCK), (3, 7)])
def test_all_pairs_equal_numpy(spark, block, group):
    """With a zero vector, vectors of another length, null and non-finite ones, and a query that is no item."""
    q, c, x = sides(spark, 230)
    odd = [(500, [0.0] * 8), (501, [1.0, 2.0]), (502, [2.0, 1.0]), (503, None), (504, [float("nan")] * 8), (505, [])]
    c = c.unionByName(spark.createDataFrame(odd, VECTOR.format("item_id")))
    q = q.unionByName(spark.createDataFrame([*odd[:4], (900, x[3].tolist())], VECTOR.format("query_id")))
    known = {**{i: v for i, v in enumerate(x)}, 500: np.zeros(8), 501: np.array([1.0, 2.0]), 502: np.array([2.0, 1.0])}
    asked = {i: known[i] for i in [*range(0, 230, 20), 500, 501, 502]} | {900: x[3]}
    cos = lambda a, b: round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) or 1.0)), 6)
    wanted = {(i, j): cos(a, b) for i, a in asked.items() for j, b in known.items() if i != j and len(a) == len(b)}
    rows = cells.all_pairs(q, c, None, block, group).collect()
    assert len(rows) == len(wanted) and {(r.query_id, r.item_id): pytest.approx(r.score, abs=2e-6) for r in rows} == wanted


def test_blocks_are_full_and_bounded(spark):
    _, c, _ = sides(spark, 1_000, parts=9)
    sizes = sorted(len(r.ids) for r in cells.blocks(c, "item_id", 100).collect())
    assert sum(sizes) == 1_000 and max(sizes) <= 100 and len(sizes) <= 20


def test_rows_shuffled_are_the_vectors(spark):
    """Vectors of 16 cells; each query was a row a cell and part before, and each item one a block."""
    rows = []
    for n in (2_000, 16_000):
        q, c, _ = sides(spark, n)
        q, c = q.localCheckpoint(), c.localCheckpoint()
        before = written(spark)
        search.cosine_pairs(q, c).write.format("noop").mode("overwrite").save()
        rows.append(written(spark) - before)
    assert rows[1] < 1.1 * (16_000 + 800) and "Cartesian" in search.cosine_pairs(q, c)._jdf.queryExecution().toString(), rows


def test_equal_scores_are_neighbours_and_come_in_pieces():
    rng = np.random.default_rng(5)
    m, c = rng.normal(size=(600, 8)), rng.normal(size=(1_000, 8))
    out = list(cells.every((np.arange(600), m), (np.arange(1_000), c)))
    score = np.concatenate([b.column(2).to_numpy() for b in out])
    assert len(score) == 600 * 999 and (np.diff(score) <= 0).all() and max(b.num_rows for b in out) <= cells.SCORES


def test_files_of_all_pairs_are_small(spark, tmp_path):
    """A full block of each side; check_l's pairs took 9.0 bytes each when they came by query."""
    _, c, _ = sides(spark, 2_048, dim=32)
    search.cosine_pairs(c.withColumnRenamed("item_id", "query_id"), c).coalesce(1).write.parquet(str(tmp_path / "out"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert n == 2_048 * 2_047 and size < 6.5 * n, size / n
