"""What a Python worker needs to score a group of vectors stays bounded."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lectern.operators import cells, search


def sides(n_queries, n_items, dim=16):
    rng = np.random.default_rng(3)
    q, c = np.round(rng.normal(size=(n_queries, dim)), 1), np.round(rng.normal(size=(n_items, dim)), 1)
    c[1::2] = c[::2]  # ties
    of = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    asked = pa.table({"dim": pa.array([dim] * len(q), pa.int32()), "query_id": pa.array(range(len(q)), pa.int64()), "embedding": of(q)})
    return q, c, asked, pa.table({"item_id": pa.array(range(len(c)), pa.int64()), "embedding": of(c)})


def test_scores_are_worked_out_in_pieces():
    q, c, asked, rows = sides(256, 16_000)
    tracemalloc.start()
    got = cells.scored(10, None)(asked, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # with two million scores at once it was 72 MB
    score = np.round((q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]), 6)
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, :10]
    assert sorted(zip(got["query_id"].to_pylist(), got["item_id"].to_pylist())) == sorted((i, int(j)) for i in range(len(q)) for j in best[i])


def test_all_pairs_come_in_small_groups(monkeypatch):
    asked = {}
    monkeypatch.setattr(cells, "nearest", lambda *a, **sizes: asked.update(sizes))
    search.cosine_pairs(None, None)
    assert asked.get("group", cells.ROWS) * asked.get("block", cells.BLOCK) <= 5_000_000
