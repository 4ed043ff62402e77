"""Item files as a data source, archives of vectors, encoding that goes on, image headers, sinks and reports."""

import json
import os
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.images import image_header
from lectern.operators import relational, search
from lectern.sources import encode, item_source, items
from lectern.streaming import jobs

ITEM = '<?xml version="1.0" encoding="euc-kr"?><문항종류><단위문항><문항 id="{i}" qt="11 선택형" cls1="{c} x"><문제><물음><단락><문자열>질문 {i}</문자열></단락></물음><답항><단락><문자열>하나</문자열></단락></답항></문제><정답><단락><문자열>1</문자열></단락></정답></문항></단위문항></문항종류>'


def put(folder, i, code="A13", pad=0):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{i:05d}.{'IML' if i % 2 else 'iml'}").write_bytes((ITEM.format(i=i, c=code) + " " * pad).encode("euc-kr"))


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(2_000):
        put(tmp_path / f"d{i % 7}", i, "A13" if i % 10 == 0 else "B", pad=6_000 if i % 10 else 0)
    (tmp_path / "d0" / "x.txt").write_text("no item")
    (tmp_path / "d0" / "broken.iml").write_text("<a")
    item_source.register(spark)
    read = lambda **more: spark.read.format("items").options(partitionBytes=4 << 20, **more)
    every = read().load(str(tmp_path))
    assert every.rdd.getNumPartitions() <= 5
    rows = {r.id: r for r in every.where("size(parse_errors) = 0").collect()}
    assert len(rows) == 2_000 and rows["42"].question == "질문 42" and rows["42"].attributes["qt"] == "11 선택형" and rows["42"].n_choices == 1
    assert every.where("size(parse_errors) > 0").select("path").head().path.endswith("broken.iml")
    some = read(wanted="cls1=\"A13").load(str(tmp_path))
    found = some.agg(F.count("*"), F.sum("bytes_read")).head()
    assert found[0] == 200 and found[1] < 0.05 * every.agg(F.sum("bytes_read")).head()[0]
    names = read(columns=json.dumps(["path", "length", "bytes_read"])).load(str(tmp_path))
    assert names.columns == ["path", "length", "bytes_read"] and names.count() == 2_001
    only = read(columns=json.dumps(["path", "length"])).load(str(tmp_path))
    assert only.count() == 2_001
    assert read().load(str(tmp_path / "none")).count() == 0


def test_stream_of_item_files_is_upserted(spark, tmp_path):
    item_source.register(spark)

    def go():
        stream = spark.readStream.format("items").load(f"{tmp_path}/in").select("path", "id", "modified")
        table = jobs.UpsertedTable(spark, f"{tmp_path}/data", "path", "modified")
        jobs.run(stream, table.take, f"{tmp_path}/checkpoint")
        return sorted((os.path.basename(r.path), r.id) for r in table.read().collect())

    for i in (1, 2):
        put(tmp_path / "in", i)
    assert go() == [("00001.IML", "1"), ("00002.iml", "2")]
    time.sleep(0.05)
    put(tmp_path / "in", 3)
    (tmp_path / "in" / "00002.iml").write_bytes(ITEM.format(i="again", c="B").encode("euc-kr"))
    assert go() == [("00001.IML", "1"), ("00002.iml", "again"), ("00003.IML", "3")]
    assert go() == [("00001.IML", "1"), ("00002.iml", "again"), ("00003.IML", "3")]


def test_encoding_goes_on_inside_a_killed_job(spark, tmp_path):
    """The encoder kills its worker after some rows; what finished tasks committed isn't encoded again."""
    log = tmp_path / "log"
    log.mkdir()
    folder, limit = str(log), 240

    def encoder(texts):
        import os
        import uuid

        done = sum(len(open(os.path.join(folder, f)).read().split()) for f in os.listdir(folder) if not f.startswith("kill"))
        if done >= limit and not os.path.exists(os.path.join(folder, "killed")):
            open(os.path.join(folder, "killed"), "w").close()
            os._exit(1)
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(texts))
        return [[1.0]] * len(texts)

    rows = spark.range(600).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    with pytest.raises(Exception, match="(?i)abort|crash|exit"):
        encode.vectorise_to(f"{tmp_path}/out", rows, encoder=encoder, batch=10, commit=20)
    kept = encode.encoded(spark, f"{tmp_path}/out", "id long, embedding array<float>, error string").count()
    assert 0 < kept < 600
    assert encode.vectorise_to(f"{tmp_path}/out", rows, encoder=encoder, batch=10, commit=20).where("error IS NULL").count() == 600
    written = [t for f in os.listdir(folder) if not f.startswith("kill") for t in open(os.path.join(folder, f)).read().split()]
    assert set(written) == {f"t{i}" for i in range(600)}
    assert len(written) - 600 <= 8 * 60  # what the running tasks had not committed, at most
    before = len(written)
    assert encode.vectorise_to(f"{tmp_path}/out", rows, encoder=encoder).count() == 600
    assert sum(len(open(os.path.join(folder, f)).read().split()) for f in os.listdir(folder) if not f.startswith("kill")) == before


def test_archives_of_vectors(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.savez(tmp_path / "a.npz", embeddings=m, ids=np.array(["x", "y", "z", "w"]))
    np.savez(tmp_path / "b.npz", item_ids=np.arange(4) + 10, embedding=m + 1)
    np.savez(tmp_path / "c.npz", whatever=m[:2])
    np.savez(tmp_path / "d.npz", embeddings=m, ids=np.arange(3))
    (tmp_path / "e.npz").write_bytes(b"not an archive")
    rows = items.read_archives(spark, str(tmp_path)).collect()
    of = lambda name: {r.id: r.embedding for r in rows if r.file.endswith(name) and r.error is None}
    assert of("a.npz") == {k: v.tolist() for k, v in zip("xyzw", m, strict=True)}
    assert of("b.npz")["12"] == [7.0, 8.0, 9.0] and of("c.npz") == {"0": [0.0, 1.0, 2.0], "1": [3.0, 4.0, 5.0]}
    assert {os.path.basename(r.file) for r in rows if r.error} == {"d.npz", "e.npz"}


def test_loading_replaces_only_the_tables_it_loads(spark, tmp_path):
    rows = lambda *sizes: spark.createDataFrame([(i, [float(i)] * n) for i, n in enumerate(sizes)] + [(99, None)], "id long, embedding array<double>")
    found = lambda: sorted((r.model, r.id) for r in spark.read.parquet(f"{tmp_path}/v").collect())
    items.load_vectors(rows(2, 2, 3, 5), f"{tmp_path}/v", {2: "two", 3: "three"}, "other")
    assert found() == [("other", 3), ("three", 2), ("two", 0), ("two", 1)]
    items.load_vectors(rows(2), f"{tmp_path}/v", {2: "two", 3: "three"}, "other")
    assert found() == [("other", 3), ("three", 2), ("two", 0)]


def images():
    def png(w, h):
        return b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)

    def jpeg(w, h, kind=0xC0, more=b""):
        return b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0" + more + b"\xff" + bytes([kind]) + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9

    table = b"\xff\xc4" + struct.pack(">H", 20) + b"\0" * 18  # a Huffman table isn't a frame
    return [
        (png(640, 480), ("png", 640, 480)), (b"GIF89a" + struct.pack("<HH", 300, 200), ("gif", 300, 200)), (b"GIF87a" + struct.pack("<HH", 1, 65535), ("gif", 1, 65535)),
        (b"BM" + b"\0" * 16 + struct.pack("<ii", 33, -44), ("bmp", 33, 44)), (jpeg(1024, 768), ("jpeg", 1024, 768)), (jpeg(10, 20, 0xC2, table * 3), ("jpeg", 10, 20)),
        (png(5, 6)[:20], ("png", 5, None)), (jpeg(1, 1)[:24], ("jpeg", None, None)), (b"\xff\xd8\xff" + b"\0" * 30, ("jpeg", None, None)), (b"RIFF....WEBP", (None, None, None)), (b"", (None, None, None)), (None, (None, None, None)),
    ]


def test_image_headers(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(images())], "i int, content binary").select("i", image_header(F.col("content")).alias("h"))
    assert {r.i: tuple(r.h) for r in df.collect()} == {i: want for i, (_, want) in enumerate(images())}


def test_a_failing_scorer_keeps_the_first_order(spark):
    first = spark.createDataFrame([(q, i, s) for q in (1, 2) for i, s in ((5, 0.5), (6, 0.9), (7, 0.7))], "query_id long, item_id long, score double")
    queries = spark.createDataFrame([(1, "bad"), (2, "good")], "query_id long, text string")
    texts = spark.createDataFrame([(5, "aaa"), (6, "a"), (7, "aa")], "item_id long, text string")

    def scorer(q, d):
        if (q == "bad").any():
            raise RuntimeError("no model")
        return d.str.len()

    rows = search.two_stage(first, queries, texts, 20, scorer).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.item_id, r.score) for r in rows] == [(1, 6, 0.0), (1, 7, 0.0), (1, 5, 0.0), (2, 5, 3.0), (2, 7, 2.0), (2, 6, 1.0)]


def test_sketches_are_merged_within_their_error(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 40).alias("day"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1000.0).alias("v"))
    days = relational.quantile_sketches(df, "v", ["g", "day"])
    older, newer = days.where("day < 30"), days.where("day >= 30")
    for r in relational.merged_profile(older.unionByName(newer), ["g"], {"p50": 0.5, "p99": 0.99}).collect():
        values = np.sort(np.array([x.v for x in df.where(F.col("g") == r.g).select("v").collect()]))
        assert r.n == len(values)
        for got, q in ((r.p50, 0.5), (r.p99, 0.99)):
            assert abs(np.searchsorted(values, got, "right") / len(values) - q) < 0.01


def test_prefixes_are_resolved_in_sorted_order(spark):
    from lectern.operators import groundtruth

    full = ["abc", "abd", "ab", "b", "ba/x", "zz", "가나다", "가"]
    short = ["ab", "abd", "a", "c", "b", "ba", "zzz", "", "가나"]
    frame = lambda xs, name: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    got = {r.short: r.resolved for r in groundtruth.resolve_prefixes(frame(short, "short"), frame([*full, *full], "full")).collect()}
    assert got == {s: min((f for f in full if f.startswith(s)), default=s, key=lambda f: f.encode()) for s in short}


def test_counters_keep_evidence(spark):
    rows = [(i, "" if i % 5 == 0 else "x", ["e" * 60] if i % 3 == 0 else []) for i in range(30)]
    df = spark.createDataFrame(rows, "f int, lang string, errors array<string>")
    found = {(r.field, r.value): (r.n, r.files) for r in relational.counters(df, {"lang": F.col("lang"), "again": F.col("lang")}, F.col("errors"), F.col("f"), shown=3).collect()}
    assert found["error", "e" * 50] == (10, "0|3|6") and found["total", "bad"] == (10, "") and found["total", "scanned"] == (30, "")
    assert found["lang", "unknown"] == (4, "") and found["again", "x"] == (16, "")


def test_wildcards_and_short_words(spark):
    rows = [(i, t) for i, t in enumerate(["One two", "twofold ONE", "a_b 100%", None, "", "ab", "one", "가나다 라", "a\nb", "x" * 5000 + "needle"])]
    items_ = spark.createDataFrame(rows, "item_id long, text string")
    words = ["one", "TWO", "a_b", "0%", "zz", "", "%", "_", "a%b", "나다", "needle", "e", "o_e", "t%d o"]
    got = {(r.word, r.item_id) for r in search.keywords(items_, spark.createDataFrame([(w,) for w in words], "word string"), 3).collect()}
    assert got == {(w, r.item_id) for w in words for r in items_.where(F.col("text").ilike(f"%{w}%")).orderBy("item_id").limit(3).collect()}


def test_star(spark, tmp_path):
    t = spark.createDataFrame([(1, "m", "a > b", True), (2, "m", "a", False)], "textbook_id long, subject string, full_path string, is_leaf boolean")
    s = spark.createDataFrame([("S1", "say \"x\", y", "d"), ("S2", None, "d")], "standard_code string, description string, domain string")
    m = spark.createDataFrame([(1, "S1", 0.5, "r"), (1, "S1", 0.9, "q"), (3, "S1", 0.1, "no book"), (1, "S9", 0.1, "no standard")], "textbook_id long, standard_code string, confidence double, reasoning string")
    items.write_star(t, s, m, f"{tmp_path}/out")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/star/mappings").collect()] == [(1, "S1", 0.9, "q")]
    flat = spark.read.csv(f"{tmp_path}/out/csv", header=True, escape='"', quote='"').collect()
    assert len(flat) == 1 and flat[0].subject == "m"
    assert {r.name: r.n for r in spark.read.json(f"{tmp_path}/out/meta").collect()} == {"textbooks": 2, "standards": 2, "mappings": 1, "unmapped_standards": 1}


def test_export_splits_large_folders(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "big").otherwise("small").alias("g"))
    items.export_partitioned(rows, f"{tmp_path}/x", ["g"], rows_per_file=200)
    files = lambda g: len([f for f in os.listdir(tmp_path / "x" / f"g={g}") if f.endswith(".parquet")])
    assert spark.read.parquet(f"{tmp_path}/x").count() == 1000 and 2 <= files("big") <= 5 and files("small") == 1
