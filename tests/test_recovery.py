"""Jobs that are started again, scratch folders, and the parts of plans that no SQL shows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import relational, search
from lectern.plans import retrieval
from lectern.session import cut, forget, scratch
from lectern.streaming import jobs

SCHEMA = "user_id long, event_id long, value double"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_upserted_table_goes_on_after_a_restart(spark, tmp_path):
    folder, rows = tmp_path / "in", [[(1, 1, 1.0), (2, 2, 2.0), (3, 3, 3.0)], [(2, 4, 4.0), (4, 5, 5.0)], [(4, 6, 6.0), (4, 7, 7.0)], [(5, 8, 8.0)]]
    for some in rows:  # each time another object and another query on the same checkpoint
        write(spark, folder, some)
        target = jobs.UpsertedTable(spark, f"{tmp_path}/data", "user_id", "event_id", compact_every=2)
        jobs.run(jobs.read(spark, str(folder), SCHEMA), target.take, f"{tmp_path}/checkpoint")
    found = jobs.UpsertedTable(spark, f"{tmp_path}/data", "user_id", "event_id")
    assert sorted(map(tuple, found.read().collect())) == [(1, 1, 1.0), (2, 4, 4.0), (3, 3, 3.0), (4, 7, 7.0), (5, 8, 8.0)]
    assert any(x.startswith("base") for x in found.parts())
    found.take(spark.createDataFrame([(1, 99, 99.0)], SCHEMA), 0)  # a replayed epoch
    assert found.read().where("event_id = 99").count() == 0
    assert jobs.UpsertedTable(spark, f"{tmp_path}/none", "user_id", "event_id").read() is None


def test_snapshot_keeps_its_result(spark, tmp_path):
    folder = tmp_path / "in"
    write(spark, folder, [(1, 1, 1.0), (1, 2, 2.0), (2, 3, 3.0)])
    total = lambda: jobs.snapshot(jobs.read(spark, str(folder), SCHEMA).groupBy("user_id").agg(F.sum("value").alias("v")), f"{tmp_path}/data", f"{tmp_path}/checkpoint")
    first = sorted(map(tuple, total().collect()))
    assert first == [(1, 3.0), (2, 3.0)] and sorted(map(tuple, total().collect())) == first
    write(spark, folder, [(2, 4, 1.0)])
    assert sorted(map(tuple, total().collect())) == [(1, 3.0), (2, 4.0)]


def test_scratch_needs_a_shared_folder(spark):
    class Conf:
        def get(self, name, default=None):
            return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(type("Session", (), {"conf": Conf()})(), "x")
    kept = cut(spark.range(3), "kept")
    assert kept.count() == 3
    forget(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(kept._lectern_path).count()


def test_running_sums_over_a_hot_group(spark):
    rows = [("a", i) for i in range(500)] + [("b", i) for i in range(5)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    assert {(r.g, r.v, r._upto) for r in relational.running(df, ["g"], ["v"], F.lit(1)).collect()} == {(g, v, v + 1) for g, v in rows}
    p = {r.g: r for r in relational.percentiles(df, "v", ["g"], {"p50": 0.5, "p99": 0.99, "low": 0.0, "high": 1.0}).collect()}
    assert (p["a"].p50, p["a"].low, p["a"].high) == (249.5, 0.0, 499.0) and p["a"].p99 == pytest.approx(494.01) and p["b"].p50 == 2.0


def test_quota_sizes(spark):
    rows = [(c, d, f"{c}{d}{i}") for c, n in (("x", 40), ("y", 3)) for d in range(4) for i in range(n if d else 2)]
    found = relational.quota(spark.createDataFrame(rows, "c string, d int, k string"), "c", "d", {"x": 20, "y": 30, "z": 5}, "k").collect()
    by = {}
    for r in found:
        by.setdefault(r.c, []).append(r.d)
    assert len(by["x"]) == 20 and len(by["y"]) == 11 and set(by) == {"x", "y"}
    assert [by["x"].count(0), *sorted(by["x"].count(d) for d in (1, 2, 3))][0] == 2 and all(by["x"].count(d) >= 5 for d in (1, 2, 3))
    assert {tuple(r) for r in found} <= set(rows)


def test_keywords_equal_ilike(spark):
    rows = [(i, t) for i, t in enumerate(["One two", "twofold ONE", "a_b 100%", None, "", "ab", "one"])]
    items = spark.createDataFrame(rows, "item_id long, text string")
    words = ["one", "TWO", "a_b", "0%", "zz", ""]
    got = {(r.word, r.item_id) for r in search.keywords(items, spark.createDataFrame([(w,) for w in words], "word string"), 2).collect()}
    want = {(w, r.item_id) for w in words for r in items.where(F.col("text").ilike(f"%{w}%")).orderBy("item_id").limit(2).collect()}
    assert got == want


def plain_tokens(text):
    return [t for t in "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split(" ") if len(t) > 1]


def test_bm25_by_hand(spark):
    docs = [(1, "red fox red"), (2, "blue fox"), (3, "green dog and fox"), (4, "")]
    corpus = spark.createDataFrame(docs, "item_id long, text string")
    q = spark.createDataFrame([(10, "red red fox"), (2, "fox blue"), (11, "none")], "query_id long, text string")
    tokens = {i: plain_tokens(t) for i, t in docs}
    mean = sum(map(len, tokens.values())) / 4

    def part(w, d):
        df, tf = sum(w in t for t in tokens.values()), tokens[d].count(w)
        return math.log((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens[d]) / mean))

    want = {(i, d): round(sum(part(w, d) for w in plain_tokens(t)), 6) for i, t in ((10, "red red fox"), (2, "fox blue")) for d in (1, 2, 3) if d != i and set(plain_tokens(t)) & set(tokens[d])}
    got = {(r.query_id, r.item_id): r.score for r in search.bm25(q, corpus).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_best_pairs_are_those_of_all_pairs(spark, sf):
    q, c = retrieval.passages(spark, sf)
    for scores in (search.bm25, search.tfidf):
        key = lambda df: sorted((r.query_id, r.rank, r.item_id, r.score) for r in search.best(df, 5).collect())
        assert key(scores(q, c, k=5)) == key(scores(q, c))


EVENTS = "user_id long, event_type string, value double, ts timestamp, event_id long"


def events(spark, folder, rows):
    import datetime

    some = [(u, "error" if i % 4 == 0 else "view", float(i), datetime.datetime(2024, 1, day, hour), i) for i, (u, day, hour) in enumerate(rows)]
    spark.createDataFrame(some, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))


def test_days_are_appended_once_and_late_rows_counted(spark, tmp_path):
    import datetime

    folder, ticks, data, seen = (f"{tmp_path}/{x}" for x in ("in", "ticks", "data", "arrivals"))
    jobs.tick(spark, ticks, datetime.datetime(1970, 1, 1))

    def go():
        stream = jobs.with_ticks(jobs.read(spark, folder, EVENTS), ticks)
        q = jobs.appended(jobs.daily_summary(stream, "1 day"), data, f"{tmp_path}/checkpoint")
        jobs.counted_arrivals(stream, seen, f"{tmp_path}/checkpoint-arrivals")
        state = q.lastProgress.stateOperators[0].numRowsTotal if q.lastProgress and q.lastProgress.stateOperators else 0
        return {r.day: r.n for r in spark.read.schema("day string, n long").parquet(data).collect()}, state

    events(spark, folder, [(1, d, h) for d in range(1, 11) for h in (1, 2, 3)])
    closed, state = go()
    assert closed == {f"2024-01-{d:02d}": 3 for d in range(1, 9)} and state <= 3
    events(spark, folder, [(2, 2, 5), (2, 2, 6), (1, 10, 7), (1, 12, 1)])  # two come after their day was closed
    closed, state = go()
    assert closed == {f"2024-01-{d:02d}": 3 for d in range(1, 10)} | {"2024-01-10": 4} and state <= 3
    assert [tuple(r) for r in jobs.late_rows(spark, data, seen).collect()] == [("2024-01-02", 2)]
    jobs.tick(spark, ticks, datetime.datetime(2024, 1, 20))
    closed, state = go()
    assert closed["2024-01-12"] == 1 and len(closed) == 11 and state <= 1
    assert go()[0] == closed  # nothing new


def test_sessions_are_closed_by_the_watermark(spark, tmp_path):
    import datetime

    folder, ticks = f"{tmp_path}/in", f"{tmp_path}/ticks"
    jobs.tick(spark, ticks, datetime.datetime(1970, 1, 1))
    go = lambda: jobs.appended(jobs.sessions(jobs.with_ticks(jobs.read(spark, folder, EVENTS), ticks), "2 hours"), f"{tmp_path}/data", f"{tmp_path}/checkpoint")
    found = lambda: sorted((r.user_id, r.started.hour, r.ended.hour, r.n) for r in spark.read.parquet(f"{tmp_path}/data").collect())
    events(spark, folder, [(1, 1, 1), (1, 1, 2), (1, 1, 9), (2, 1, 3)])
    go()
    assert found() == []
    events(spark, folder, [(2, 1, 4), (1, 3, 5)])
    go()
    assert found() == [(1, 1, 2, 2), (1, 9, 9, 1), (2, 3, 4, 2)]
    jobs.tick(spark, ticks, datetime.datetime(2024, 1, 9))
    go()
    assert found() == [(1, 1, 2, 2), (1, 5, 5, 1), (1, 9, 9, 1), (2, 3, 4, 2)]


def test_response_state_is_keyed_cleared_and_falls(spark, tmp_path):
    import datetime

    schema = "session_id long, response_id string, value double, ts timestamp, event_id long"
    at = lambda day, hour=0: datetime.datetime(2024, 1, day, hour)

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def go():  # each run is another query on the same checkpoint
        q = jobs.response_state(jobs.read(spark, f"{tmp_path}/in", schema), f"{tmp_path}/data", f"{tmp_path}/checkpoint", lifetime=5 * 86_400)
        state = q.lastProgress.stateOperators[0].numRowsTotal if q.lastProgress else None
        return {(r.session_id, r.response_id): r.value for r in jobs.responses(spark, f"{tmp_path}/data").collect()}, state

    put([(1, "a", 1.0, at(1), 1), (1, "a", 2.0, at(1, 5), 2), (1, "b", 3.0, at(1), 3), (2, "a", None, at(1), 4), (2, "b", 7.0, at(1, 2), 6), (2, "b", 8.0, at(1, 2), 5)])
    values, state = go()
    assert values == {(1, "a"): 2.0, (1, "b"): 3.0, (2, "b"): 7.0} and state >= 4
    put([(1, "a", 9.0, at(1, 1), 7), (1, "b", None, at(1, 3), 8), (2, "a", 4.0, at(1, 4), 9)])  # an older one, a cleared one, one after a clearing
    assert go()[0] == {(1, "a"): 2.0, (2, "a"): 4.0, (2, "b"): 7.0}
    put([(3, "a", 1.0, at(20), 10)])
    put([(3, "b", 1.0, at(21), 11)])
    go()
    put([(4, "a", 1.0, at(22), 12)])
    values, last = go()
    assert values == {(1, "a"): 2.0, (2, "a"): 4.0, (2, "b"): 7.0, (3, "a"): 1.0, (3, "b"): 1.0, (4, "a"): 1.0}
    assert last < state * 2  # three keys and their timers are left of seven
