"""Operators 11 to 13 against brute force and round trips, with their defined cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import fim, jaccard, minhash, negatives, queries

SCHEMA = "doc_id long, text string, lang string, n int, form string, OUTPUT int, component_id long, kept string"
LONG = " ".join(f"word{i % 977}" for i in range(800_000))  # over five megabytes
NEAR = [f"w{i}" for i in range(300)]


def texts():
    near = lambda *drop: " ".join(w for i, w in enumerate(NEAR) if i not in drop)
    rows = [None, "", " \n\t ", "one", "One", "one two", "one two three", near(), near(5), near(5, 90), near(5, 90, 200).upper(), near(*range(0, 300, 9)), "ä 中文 \U0001f600 é", "a <P> marker", "<S", "x" * 20_000, LONG, LONG + " end"]
    return [(i + 1, t) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, None if d % 2 else "en", None, "f", 3, 7, "k") for d, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def doubled(df):
    """Every row twice, and two rows without id."""
    return df.unionByName(df).unionByName(df.where("doc_id IN (8, 9)").withColumn("doc_id", F.lit(None).cast("long")))


# --- 11


def plain_superminhash(elements, places):
    """One set, one element and one step at a time, no early stop."""
    out = [int(minhash.FULL)] * places
    mask = (1 << 64) - 1
    for g in elements:
        perm = list(range(places))
        for step in range(places):
            drawn = int(jaccard.mix(np.array([(g + (step + 1) * int(minhash.STEP)) & mask], np.uint64))[0])
            k = step + ((drawn & 0xFFFFFFFF) * (places - step) >> 32)
            perm[step], perm[k] = perm[k], perm[step]
            out[perm[step]] = min(out[perm[step]], drawn >> 32 | step << 32)
    return out


def test_superminhash_is_the_plain_one():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 2, 7, 40, 300, 1500]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    g = rng.integers(0, 1 << 63, len(doc)).astype(np.uint64)
    got = minhash.superminhash(doc, g, len(sizes), 32)
    assert [list(map(int, r)) for r in got] == [plain_superminhash([int(x) for x in g[doc == d]], 32) for d in range(len(sizes))]


def test_superminhash_estimates_with_less_variance():
    """Mean of the estimate is the similarity; for sets smaller than the signature its variance is below that of independent hashes."""
    rng = np.random.default_rng(2)
    places, errors = 64, []
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        a, b = both[:50], both[10:]  # 40 of 60
        sig = minhash.superminhash(np.repeat([0, 1], [50, 50]), np.concatenate((a, b)), 2, places)
        errors.append((sig[0] == sig[1]).mean() - 40 / 60)
    independent = (40 / 60) * (20 / 60) / places
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.8 * independent


def test_minhash_groups(spark, odd, docs):
    for df in (odd, docs.select("doc_id", "text")):
        want = jaccard.brute_force([(r.doc_id, r.text) for r in df.collect()], 2, 80)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(df).collect()}
        assert got == want
    assert minhash.groups(odd.limit(0)).count() == 0
    again = minhash.keep_one(doubled(odd))  # copies of a row stay or go together
    assert again.columns == odd.columns
    kept = [d for d, (_, c) in jaccard.brute_force(texts(), 2, 80).items() if c == d]
    assert sorted(r.doc_id or 0 for r in again.select("doc_id").collect()) == sorted([0, 0, *kept, *kept])


def test_minhash_large_group(spark):
    """A large group of copies, a large group of near copies in a chain, and texts just below the threshold."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    rows, words = [(i, " ".join(base)) for i in range(400)], list(base)
    for i in range(400, 700):  # each is near the one before; the ends have nothing in common
        words[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(words)))
    for i in range(700, 900):
        w = list(base)
        for j in rng.sample(range(120), 9):
            w[j] = f"o{i}-{j}"
        rows.append((i, " ".join(w)))
    want = jaccard.brute_force(rows, 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == want


# --- 12


def mined(df, **kw):
    found = negatives.mine(negatives.items(df, F.col("label"), F.col("embedding"), F.col("vec_id")), F.col("id") % 5 == 0, **kw)
    return sorted(tuple(r) for r in found.collect())


VECTORS = "vec_id long, embedding array<float>, label int, score string, id string"


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "group": 20}])
def test_negatives(spark, sizes):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)], rng.randrange(3), "s", "x") for i in range(200)]  # many ties
    rows += [(500, None, 1, None, None), (505, [0.5, None, 0.5, 0.5], 1, None, None), (510, [math.nan, 0.0, 0.0, 0.0], 1, None, None), (515, [math.inf, 0.0, 0.0, 0.0], 1, None, None)]
    rows += [(520, [0.5] * 4, None, None, None), (525, [], 1, None, None), (526, [], 1, None, None), (530, [0.5, 0.5], 1, None, None), (531, [0.5, 0.4], 1, None, None), (532, [0.3, 0.3], 2, None, None)]
    rows += [(None, [0.5] * 4, 1, None, None), (540, [1e30, 0.0, 0.0, 0.0], 1, None, None), (545, [0.0] * 4, 1, None, None)]
    rows += rows[:40] + [(0, [1.0] * 4, 2, None, None)]  # repeated rows, and another row of one id
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = negatives.brute_force([(r[0], r[2], r[1]) for r in rows], lambda i: i % 5 == 0)
    assert want and mined(df, **sizes) == want
    assert mined(df.limit(0)) == []


def test_negatives_of_one_label_and_one_vector(spark):
    """A third of all rows are one vector of one label: ties go to the smaller ids."""
    rows = [(i, [0.5, 0.5], 1) for i in range(300)] + [(i, [0.4, 0.4], 2) for i in range(300, 600)] + [(i, [i / 900, 0.1], 3) for i in range(600, 900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert mined(df, group=100) == negatives.brute_force([(a, c, [float(np.float32(x)) for x in b]) for a, b, c in rows], lambda i: i % 5 == 0)


def test_windows_open_and_close():
    """A window closes when it is full; batches may split an anchor anywhere."""
    rows = [(1, 0, 0, 100, 7), (1, 0, 1, 96, 8), (1, 0, 1, 95, 9), (1, 0, 0, 90, 2), (1, 0, 1, 80, 3), (1, 0, 1, 60, 4), (1, 0, 1, 49, 5), (2, 0, 1, 9, 5)]
    import pyarrow as pa

    for size in (1, 3, len(rows)):
        batches = [pa.RecordBatch.from_pydict(dict(zip(negatives.FOUND.names, zip(*rows[i : i + size], strict=True), strict=True)), negatives.FOUND) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in negatives.windows(iter(batches), 5, 2, 50, 95) for r in b.to_pylist()]
        assert sorted(got) == [(1, 2, 1, 3, 90, 80), (1, 2, 2, 4, 90, 60), (1, 7, 1, 9, 100, 95), (1, 7, 2, 3, 100, 80)]


# --- 13


def test_fim_on_odd_rows(spark, odd, docs):
    for df in (odd, docs):
        for kw in ({}, {"seed": 7, "rate": 100, "spm_rate": 0}, {"rate": 100, "spm_rate": 100}):
            moved = fim.transform(df, **kw)
            for r in fim.restore(moved).collect():
                want = fim.brute_force(r["doc_id"], r["text"], **kw)
                assert {k: r[k] for k in want} == want
                assert r["restored"] == (r["text"] or "")
    assert fim.transform(odd.limit(0)).count() == 0
    moved = fim.transform(odd)
    assert moved.columns == ["doc_id", "text", "lang", "n_input", "form_input", "OUTPUT_input", "component_id", "kept", *fim.ADDED]
    assert {r.n_input for r in moved.collect()} == {None} and {r.OUTPUT_input for r in moved.collect()} == {3}
    again = fim.restore(fim.transform(doubled(odd))).collect()
    assert len(again) == 2 * odd.count() + 2
    assert all(r.restored == (r.text or "") for r in again)


def test_fim_of_random_texts(spark):
    rng = random.Random(11)
    alphabet = " \t\n\x0b\x0c\r<>PSMabé中\U0001f600"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 5, 30])))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for r in fim.restore(fim.transform(df, rate=100)).collect():
        want = fim.brute_force(r.doc_id, r.text, rate=100)
        assert {k: r[k] for k in want} == want and r.restored == r.text


def test_restore_refuses_what_no_text_gives(spark):
    rows = [("psm", "<P>a<S>b<M>c"), ("spm", "<P>a<S>b<M>c"), ("psm", "<P>a<S>b"), ("psm", "x<P>a<S>b<M>c"), ("psm", "<P>a<S>b<M>c<M>"), ("plain", "<P>"), ("other", "a"), (None, "a"), ("psm", None), ("plain", None), ("spm", "<S><P><M>"), ("psm", "")]
    got = [r.restored for r in fim.restore(spark.createDataFrame(rows, "form string, output string").coalesce(1)).collect()]
    assert got == ["acb", None, None, None, None, "<P>", None, None, None, None, "", None]


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF20C3' AS STRING) AS text UNION ALL SELECT 2L, CAST(X'8061' AS STRING)")
    moved = fim.restore(fim.transform(df, rate=100))
    assert moved.where("CAST(restored AS BINARY) <> CAST(text AS BINARY)").count() == 0


@pytest.mark.parametrize("name", ["op11_minhash", "op12_hard_negatives", "op13_fill_in_middle"])
def test_sql(spark, sf, name):
    import duckdb

    from lectern.llm.oracle import ORACLE

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf)
    wanted = con.sql(ORACLE[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    names = sorted(found.columns)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r[c] for c in names) for r in found.collect()), key=key) == sorted(wanted.select(*names).fetchall(), key=key)
