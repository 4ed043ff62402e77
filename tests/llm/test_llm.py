"""The ten operators against brute force, round trips and held-out accuracy, with their defined cases."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, classify, decontaminate, exchange, jaccard, license_scan, line_dedup, lm, packed, quality_model, quality_rules, queries, sharding, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, key string, char_ref string, ids int, label string"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
NEAR = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, "   \n\t\n"), (4, "Short line"), (5, PASSAGE), (6, PASSAGE.upper() + "\nA shared line here\nx"), (7, "a shared LINE here  \nown line of seven\n\n"),
    (8, NEAR), (9, NEAR + " extra"), (10, NEAR.replace("w30 ", "")), (11, NEAR), (12, "zero " + " ".join(PASSAGE.split()[:9])), (13, "ab " * 400), (14, "äöü ß 中文 한국어 \U0001f600 é"), (15, "Released under the MIT License.\nmore text"), (16, "a b c d"), (17, "A B c D"), (18, "longword" * 3000),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names."""
    rows = [(d, t, None if d % 5 == 0 else "en", None if d % 3 == 0 else "s", d, None, "k", "c", d, "l") for d, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(spark, odd):
    nulls = odd.where("doc_id IN (5, 8)").withColumn("doc_id", F.lit(None).cast("long"))
    return odd.unionByName(odd).unionByName(nulls)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_sharding(spark, odd, empty, repeated, docs):
    for df in (odd, docs, repeated):
        rows = sharding.place(df, 16, blocks=8).collect()
        assert len(rows) == df.count()
        slots = {}
        for r in rows:
            key = r.doc_id or 0
            assert (r.shard, r.grown_shard) == (sharding.brute_force(key, 16), sharding.brute_force(key, 17))
            assert r.grown_shard in (r.shard, 16)
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = {r.doc_id: r for r in sharding.place(odd).collect()}
    for d, t in TEXTS:
        assert (got[d].size, got[d].text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sharding.place(empty).count() == 0


@pytest.mark.parametrize("key", [0, 1, -1, 2**63 - 1, -(2**63), 123456789123])
def test_jump_hash_extremes(spark, key):
    for n in (1, 2, 7, 1000):
        assert spark.range(1).select(sharding.jump_shard(F.lit(key), n)).head()[0] == sharding.brute_force(key, n)


def test_line_dedup(spark, odd, empty, docs, repeated):
    for df in (odd, docs.select("doc_id", "text")):
        want = line_dedup.brute_force([(r.doc_id, r.text) for r in df.collect()])
        for batches, fanout in ((1, 2), (5, 2), (7, 3)):
            got = {r.doc_id: (r._ld_lines, r._ld_dropped, r.text) for r in line_dedup.dedup_lines(df, batches, fanout).collect()}
            assert got == want
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(repeated).count() == repeated.count()
    with pytest.raises(ValueError, match="_ld_key"):
        line_dedup.dedup_lines(odd.withColumn("_ld_key", F.lit(1)))


def test_line_dedup_of_many_lines(spark):
    """A document of which every other line is dropped; rows that share a doc_id are one document."""
    lines = [f"a line with number {i}" for i in range(20_000)]
    rows = [(1, "\n".join(lines[::2])), (2, "\n".join(lines)), (3, lines[1]), (3, lines[0] + "\n" + lines[1]), (3, "only here, in row three")]
    got = {(r.doc_id, r._ld_lines): (r._ld_dropped, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, 10_000] == (0, rows[0][1]) and got[2, 20_000] == (10_000, "\n".join(lines[1::2]))
    assert got[3, 2] == (2, "")


def test_line_runs_levels(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    make = lambda ids: spark.createDataFrame([(bytes([k]), i) for i in ids for k in range(i, i + 3)], line_dedup.LineRuns.SCHEMA)
    for i in range(4):
        runs.add(make([i]))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    owners = {r._ld_key[0]: r._ld_owner for r in runs.read().collect()}
    assert owners == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3}


def test_license_scan(spark, odd, empty):
    hits = {r.doc_id: r._ls_hits for r in license_scan.scan(odd).collect()}
    assert [(h.license_id, h.dice, h.unit) for h in hits[15]] == [("MIT", 1.0, "Released under the MIT License."), ("MIT", 0.8, dict(TEXTS)[15])]
    assert not any(hits[d] for d, _ in TEXTS if d != 15)
    assert license_scan.scan(empty).count() == 0
    assert not any(r._ls_hits for r in license_scan.scan(odd, templates=[]).collect())
    mit = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 100)
    whole = spark.createDataFrame([(1, mit.replace(", ", ",\n").upper())], "doc_id long, text string")
    assert [h.license_id for h in license_scan.scan(whole).head()._ls_hits] == ["MIT"]


@pytest.mark.parametrize("bits", [29, 6])  # six bits let every window through to the join
def test_decontamination(spark, sf, odd, empty, docs, repeated, bits):
    bench = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE), (3, "w1 w2"), (4, ""), (5, None), (None, "a b"), (6, NEAR), (6, NEAR)], "item_id long, text string")
    for df, items in ((odd, bench), (docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet"))):
        want = decontaminate.brute_force([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in items.collect() if r.item_id is not None])
        rows = decontaminate.mark(df, items, most_bits=bits).withColumn("n_hit", decontaminate.n_hit(F.col("_dc_spans"))).collect()
        assert {r.doc_id: (r._dc_words, r.n_hit, r._dc_items) for r in rows} == want
    assert decontaminate.mark(empty, bench).count() == 0
    assert not any(r._dc_spans for r in decontaminate.mark(odd, bench.limit(0)).collect())
    again = decontaminate.mark(repeated, bench, most_bits=bits)
    assert again.columns[: len(odd.columns)] == odd.columns and again.count() == repeated.count()
    assert {len(r._dc_spans) > 0 for r in again.where("doc_id IS NULL").collect()} == {True}
    with pytest.raises(ValueError, match="_dc_words"):
        decontaminate.mark(odd.withColumn("_dc_words", F.lit(1)), bench)


def test_bpe(spark, odd, empty, docs, repeated):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    known, vocabulary = tokenizers.Tokenizer.from_file(path), bpe.load(path)
    odd = odd.unionByName(spark.createDataFrame([(99, "a<|endoftext|>'ve   x\x1c\x85 aaaa " * 3)], "doc_id long, text string"), allowMissingColumns=True)
    for df in (odd, docs):
        both = bpe.encode(df, vocabulary, decoded="again")
        for r in bpe.decode(both, vocabulary).collect():
            assert r.again == r.decoded
            ids = known.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == ids
            assert r.decoded == known.decode(ids, skip_special_tokens=False) == (r.text or "")
    assert bpe.encode(empty, vocabulary).count() == 0
    assert bpe.encode(repeated, vocabulary).count() == repeated.count()
    broken = spark.createDataFrame([(1, bytes([97, 0xFF, 0xC3, 98]))], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    assert bpe.encode(broken, vocabulary).head().ids == known.encode("a\ufffd\ufffdb", add_special_tokens=False).ids
    bad = spark.createDataFrame([([known.encode("é").ids[0], 10**6, -1, None],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(bad, vocabulary).collect()][1] == ""


def test_lm(spark, odd, empty, docs):
    for df in (odd, docs):
        rows = lm.score(df, train=classify.fold(F.col("doc_id"), 7) != 2, chunk_keys=8_000, bucket_keys=5_000).collect()
        tokens = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER)), None] for r in df.collect()}
        count = Counter(t for d, ts in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for t in ts)
        n, v = sum(count.values()), len(count)
        assert len(rows) == len(tokens)
        for r in rows:
            ts = tokens[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens, r.train_types) == (len(ts), sum(count[t] > 0 for t in ts), n, v)
            assert r.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts))
            assert r.score < 0
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(empty, train=F.lit(True)).count() == 0
    assert lm.score(odd, train=F.lit(False)).count() == odd.count()


def test_lm_scores_are_those_of_a_plain_model(spark, odd):
    """The same chunks held out, the same cells and weights: scores equal those from plain dictionaries."""
    texts = [(i, " ".join(f"w{(i * i + j * j) % (7 + i % 5)}" for j in range(3 + i % 9))) for i in range(60)] + [(60, None), (61, "W1 w1\tw2")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in lm.score(df, train=F.col("doc_id") % 5 != 2, folds=3).collect()}
    import pyarrow as pa

    size = sum(len(t or "") for _, t in texts) // 6  # one partition: chunks of a sixth of the bytes, every third held out
    held = {texts[k][0]: c % 3 == 0 for c, (i, j, _, _) in enumerate(packed.slices(pa.array([t for _, t in texts]), size)) for k in range(i, j)}
    want = lm.brute_force([(t, d % 5 != 2) for d, t in texts], [held[d] for d, _ in texts])
    assert any(held.values()) and [got[d] for d, _ in texts] == pytest.approx(want)


def test_lm_weights():
    """Every bucket's weights sum to 1; unknown contexts give nothing to the orders that need them."""
    table = lm.weight_table({lm.LEVELS: (0.4, 0.3, 0.2, 0.1), 3: (0.0, 0.5, 0.3, 0.2)})
    assert table.sum(1) == pytest.approx(1) and not table[: lm.LEVELS, 0].any() and table[0, 1] == 0
    assert table[lm.LEVELS + 5].tolist() == [0.4, 0.3, 0.2, 0.1] and table[9].tolist() == [0.0, 0.5, 0.3, 0.2]


def test_em_finds_the_mixture():
    import numpy as np

    k = lm.LEVELS + 2
    cells = np.array([(k, 0, -1, 4, 900), (k, -1, -1, 4, 100)])  # a trigram probability of 1 nine times out of ten
    w = lm.expectation_maximisation(cells, types=10**6)[k]
    assert w[0] == pytest.approx(0.87, abs=0.05) and sum(w) == pytest.approx(1)


@pytest.mark.parametrize(("module", "label", "threshold"), [(toxicity, "toxic", 0.7), (quality_model, "quality", 0.5)])
def test_classifiers(spark, odd, empty, module, label, threshold):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    held = classify.fold(F.col("doc_id"), 3) == 1
    model = module.learn(docs, labels.where(~held))
    rows = module.score(docs, model).join(labels, "doc_id").where(held).collect()
    assert sum((r.score >= threshold) == bool(r[label]) for r in rows) / len(rows) > 0.93
    scored = module.score(odd, model).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r.score <= 1 for r in scored) and "text" not in scored[0]
    assert module.score(empty, model).count() == 0
    blank = module.learn(empty, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in module.score(odd, blank).collect())


def plain_figures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, empty, docs, repeated, sf):
    for df in (odd, docs):
        for r in quality_rules.judge(df).collect():
            q = r._qr
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == plain_figures(r.text)
            assert r._qr_failed == (q.n_words < 20 or 100 * q.n_repeat_words > 30 * q.n_words)
            assert not (r._qr_failed and r._qr_kept)
    light = quality_rules.judge(docs, keep_text=False)
    assert "text" not in light.columns
    both = light.join(quality_rules.judge(docs).select("doc_id", F.col("_qr").alias("q"), F.col("_qr_kept").alias("k")), "doc_id")
    assert both.where("NOT (_qr <=> q) OR _qr_kept <> k").count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id")
    assert judged.where("quality = 1 AND NOT _qr_failed AND NOT _qr_kept").count() == 0
    assert judged.where("quality = 0 AND _qr_kept").count() <= 15
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.judge(repeated).count() == repeated.count()
    with pytest.raises(ValueError, match="_qr_kept"):
        quality_rules.judge(odd.withColumn("_qr_kept", F.lit(True)))


def test_quality_rules_wrong_language(spark):
    """Texts under another language's name, and word salad, are rejected by the words alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").select("doc_id")
    good = docs.join(labels, "doc_id").where("lang = 'en' AND size(split(text, ' ')) BETWEEN 256 AND 1000 AND doc_id % 6 = 0")
    wrong = good.select((-1 - F.col("doc_id")).alias("doc_id"), "text", F.lit("fr").alias("lang"))
    salad = good.select((-1000000 - F.col("doc_id")).alias("doc_id"), F.regexp_replace("text", "([a-z])([a-z]+)", "$2$1").alias("text"), "lang")
    judged = quality_rules.judge(docs.union(wrong).union(salad)).where("doc_id < 0 AND NOT _qr_failed").collect()
    assert {r.lang for r in judged} == {"en", "fr"} and not any(r._qr_kept for r in judged)
    assert all(r._qr.words_distance > r._qr.words_bound for r in judged)


# The character classes of the quality rules but for the last, "other".
CLASSES = ["[a-z]", "[A-Z]", "[0-9]", "[ \\x09-\\x0D]", "[.,;:!?'\"()-]", "[\\x00-\\x08\\x0E-\\x1F#$%&*+/<=>@\\[\\\\\\]^_`{|}~\\x7F]"]


def plain_js(p, q):
    a, b = sum(p), sum(q)
    if not a or not b:
        return None
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(x / a, (x / a + y / b) / 2) + part(y / b, (x / a + y / b) / 2) for x, y in zip(p, q, strict=True)) / 2))


def plain_kept(rows, slot, common=64):
    """(doc_id, kept) of (doc_id, text, lang) rows by plain Python; ``slot`` gives the slots of some words."""
    chars = {d: [len(re.findall(c, t or "")) for c in CLASSES] for d, t, _ in rows}
    chars = {d: [*n, len(t or "") - sum(n)] for (d, t, _), n in zip(rows, chars.values(), strict=True)}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t, _ in rows}
    ref = {}
    for lang in {x for _, _, x in rows if x is not None}:
        mine = [d for d, _, x in rows if x == lang]
        count = Counter(w for d in mine for w in words[d])
        if sum(count.values()) >= 2000:
            top = sorted(count, key=lambda w: (-count[w], w.encode()))[:common]
            slots = slot(top)
            top = [w for k, w in enumerate(top) if slots[w] not in [slots[x] for x in top[:k]]]
            shares = [count[w] for w in top]
            ref[lang] = [sum(x) for x in zip(*[chars[d] for d in mine], strict=True)], top, [*shares, sum(count.values()) - sum(shares)]
    far = {}
    for d, t, lang in rows:
        if lang in ref:
            held = Counter(words[d])
            some = [held[w] for w in ref[lang][1]]
            far[d] = (plain_js([*some, len(words[d]) - sum(some)], ref[lang][2]) if len(words[d]) >= 50 else None, plain_js(chars[d], ref[lang][0]) if len(t) >= 200 else None)
    octave = lambda d: len(words[d]).bit_length() - 1
    seen = {}
    for d, _, lang in rows:
        w, c = far.get(d, (None, None))
        for kind, x in ((octave(d), w), (-1, w), (-2, c)):
            if x is not None:
                seen.setdefault((lang, kind), []).append(int(x * 1000))
    quartile = lambda v, q: (sorted(v)[max(0, math.ceil(q * len(v)) - 1)] + 0.5) / 1000
    bound = {}
    for (lang, kind), v in seen.items():
        low, middle, high = (quartile(v, q) for q in (0.25, 0.5, 0.75))
        if kind < 0 or len(v) >= 20:
            bound[lang, kind] = 2.5 * middle if kind == -2 else high + 2.0 * (high - low)
    out = {}
    for d, t, lang in rows:
        n, _, _, _, again = plain_figures(t)
        w, c = far.get(d, (None, None))
        odd = c is not None and (lang, -2) in bound and c > bound[lang, -2]
        limit = bound.get((lang, octave(d)), bound.get((lang, -1)))
        out[d] = not (n < 20 or 100 * again > 30 * n) and not odd and not (w is not None and limit is not None and w > limit)
    return out


def test_quality_verdicts_are_those_of_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    slot = lambda top: {r.w: r.s for r in spark.createDataFrame([(w,) for w in top], "w string").select("w", quality_rules.slot_of(F.col("w")).alias("s")).collect()}
    want = plain_kept([tuple(r) for r in docs.collect()], slot)
    assert {r.doc_id: r._qr_kept for r in quality_rules.judge(docs, keep_text=False).collect()} == want
    assert 0.5 < sum(want.values()) / len(want) < 1


def test_word_distance(spark):
    """The distance over the words a text holds equals that of the whole histograms."""
    text, top, shares = "a b b x a b y", ["a", "b", "c"], [0.2, 0.3, 0.1, 0.4]
    slots = [0] * quality_rules.SLOTS
    for w, s in ((r.w, r.s) for r in spark.createDataFrame([(w,) for w in top], "w string").select("w", quality_rules.slot_of(F.col("w")).alias("s")).collect()):
        slots[s] = top.index(w) + 1
    row = spark.createDataFrame([(text.split(), top, slots, shares, [2, 3, 0, 2])], "ws array<string>, top array<string>, slots array<int>, shares array<double>, n array<long>")
    got, want = row.select(quality_rules.word_distance(*map(F.col, ("ws", "top", "slots", "shares"))), quality_rules.js_distance(F.col("n"), F.col("shares"))).head()
    assert got == pytest.approx(want)


def test_js_distance(spark):
    row = spark.createDataFrame([([1, 0], [0, 1], [2, 2], [0, 0])], "p array<long>, q array<long>, r array<long>, z array<long>")
    d = lambda a, b: row.select(quality_rules.js_distance(F.col(a), F.col(b))).head()[0]
    assert d("p", "q") == pytest.approx(1) and d("p", "p") == 0 and d("p", "z") is None
    m = [0.75, 0.25]
    want = math.sqrt((math.log2(1 / m[0]) + sum(0.5 * math.log2(0.5 / x) for x in m)) / 2)
    assert d("p", "r") == pytest.approx(want)


def test_jaccard(spark, odd, empty, docs, repeated):
    for df in (odd, docs):
        want = jaccard.brute_force([(r.doc_id, r.text) for r in df.collect()])
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(df).collect()}
        assert got == want
    assert jaccard.components_of(empty).count() == 0
    rows = jaccard.components_of(repeated).collect()
    assert len(rows) == repeated.count() and all(r.component_id is None for r in rows if r.doc_id is None)
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in jaccard.brute_force(TEXTS).items() if d == c}


def test_jaccard_groups_and_passage(spark):
    """A large group of near copies and a passage that many other documents hold, against brute force."""
    import random

    r = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(80)] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, passage + " " + " ".join(f"o{r.randrange(60)}" for _ in range(r.randrange(1, 12)))) for i in range(150)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.components_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == jaccard.brute_force(rows)


def test_exchange():
    import numpy as np

    counts = np.array([0, 1, 2**32 + 5, 2**63], dtype=np.uint64)
    for some in (counts, counts[:2], counts[:0], np.array([300])):
        assert exchange.unpack_counts(exchange.pack_counts(some)).tolist() == some.tolist()
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 300_000, dtype=np.uint64))
    assert exchange.unpack_sorted(exchange.pack_sorted(keys)).tolist() == keys.tolist()
    for buckets in (1, 100, 1_000_000):  # nothing is done for a bucket without keys
        found = list(exchange.messages(keys, buckets))
        assert [a for _, a, _ in found] == [0, *[e for _, _, e in found[:-1]]] and found[-1][2] == len(keys)
        assert len(found) <= min(buckets, len(keys)) and len({b for b, _, _ in found}) == len(found)
        assert all(keys[a] * 1 >= b * (2**64 // buckets) - buckets for b, a, _ in found[:100])
    for size in (10**3, 10**9, 10**13):
        chunk, buckets = exchange.scale(size, 350_000, 1_000_000)
        assert max(chunk, size / buckets) <= exchange.MOST_KEYS * 1.01 and chunk / buckets >= 1 / 4 or size <= 10**9


def test_jaccard_chain(spark):
    """A group whose ends aren't similar is one component through its middle; no pair of it is lost."""
    words = [f"w{i}" for i in range(130)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 70])) for i in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in jaccard.brute_force(rows).items()}
    assert set(got.values()) == {0}


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for (name, stage), check in zip(p.STAGES, (plain_quality, plain_lines, plain_near, plain_clean, None), strict=True):
        before = docs.collect()
        after = stage(spark, docs, sf)
        if check is None:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before}
            break
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
        check(before, docs.collect(), spark, sf)


def test_pipeline_stages_on_odd_rows(spark, sf, odd, empty, repeated):
    """Nulls, empty and long texts, ties, repeated rows, an empty table, other columns: each stage takes them all."""
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        found = stage(spark, odd, sf)
        rows = found.collect()
        assert name == "bpe" or found.columns == odd.columns, name
        assert stage(spark, empty, sf).count() == 0, name
        again = Counter(r.doc_id for r in stage(spark, repeated, sf).select("doc_id").collect())
        kept = {r.doc_id for r in rows}
        whole = name in ("line_dedup", "bpe")
        assert {d for d in again if d is not None} == kept and kept <= {d for d, _ in TEXTS} and (not whole or len(kept) == len(TEXTS)), name
        assert all(n == 2 for d, n in again.items() if d is not None), name
        assert again[None] == (2 if name in ("line_dedup", "bpe", "ngram_jaccard_join") else again[None]), name


def plain_quality(before, after, spark, sf):
    kept = {r.doc_id for r in after}
    for r in before:
        n, _, _, _, again = plain_figures(r.text)
        if n < 20 or 100 * again > 30 * n:
            assert r.doc_id not in kept


def plain_lines(before, after, spark, sf):
    want = line_dedup.brute_force([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == {d: t for d, (_, _, t) in want.items()}
    assert all(r.n_chars == len(r.text) for r in after)


def plain_near(before, after, spark, sf):
    want = jaccard.brute_force([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {d for d, (_, c) in want.items() if d == c}


def plain_clean(before, after, spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = decontaminate.brute_force([(r.doc_id, r.text) for r in before], items)
    assert {r.doc_id for r in after} == {d for d, (_, n, _) in want.items() if not n}


COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op2_toxicity": "doc_id held_out score predicted", "op3_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op5_benchmark_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated", "op6_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op7_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score", "op8_quality_classifier": "doc_id held_out score predicted",
    "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op10_ngram_jaccard_join": "doc_id n_shingles component_id",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, sf, docs, name):
    """Every registered query on whole tables: its columns, one row a document, and the digests of the plain versions."""
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = queries.QUERIES[name](spark, sf)
    assert name == "op4_license_scans" or set(COLUMNS[name].split()) <= set(out.columns)
    rows, texts = {r.doc_id: r for r in out.collect()}, {r.doc_id: r.text for r in docs.collect()}
    assert set(rows) == set(texts) and out.count() == docs.count()
    plain = list(texts.items())
    if name == "op3_line_dedup":
        assert {d: (r.n_lines, r.n_dropped, r.kept_sha256) for d, r in rows.items()} == {d: (n, k, sha(t)) for d, (n, k, t) in line_dedup.brute_force(plain).items()}
    if name == "op5_benchmark_decontamination":
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        want = {d: (n, h, len(i), sha(",".join(i)), h > 0) for d, (n, h, i) in decontaminate.brute_force(plain, items).items()}
        assert {d: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for d, r in rows.items()} == want
    if name == "op6_bpe":
        known = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary_path())
        for d, t in plain:
            ids = known.encode(t or "", add_special_tokens=False).ids
            assert (rows[d].n_tokens, rows[d].ids_sha256, rows[d].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(known.decode(ids, skip_special_tokens=False)))
    if name == "op9_quality_rules":
        for d, t in plain:
            n, chars, symbols, lines, again = plain_figures(t)
            assert (rows[d].n_words, rows[d].word_chars, rows[d].n_symbols, rows[d].n_dup_lines, rows[d].n_repeat_words, rows[d].base_failed) == (n, chars, symbols, lines, again, n < 20 or 100 * again > 30 * n)
            assert not (rows[d].base_failed and rows[d].kept)
    if name == "op10_ngram_jaccard_join":
        assert {d: (r.n_shingles, r.component_id) for d, r in rows.items()} == jaccard.brute_force(plain)
    folds, threshold = {"op2_toxicity": (3, 0.7), "op8_quality_classifier": (3, 0.5), "op7_lm_scoring": (7, None)}.get(name, (None, None))
    if folds:
        for d, r in rows.items():
            assert r.held_out == (zlib.crc32(str(d).encode()) % folds == (2 if folds == 7 else 1))
            assert threshold is None or (0 <= r.score <= 1 and r.predicted == (r.score >= threshold))


def test_prior_is_estimated():
    """A mixture of a third positives: the estimate comes near it without any negative label."""
    import numpy as np

    r = np.random.default_rng(3)
    p, n = r.beta(8, 2, 4000), r.beta(2, 6, 8000)
    found = quality_model.estimated_prior(quality_model.binned(p), quality_model.binned(np.concatenate([r.beta(8, 2, 4000), n])))
    assert found == pytest.approx(1 / 3, abs=0.06)


def test_non_negative_risk():
    """Two clouds: positives of one, unlabelled rows of both; the model tells them apart."""
    import numpy as np

    r = np.random.default_rng(4)
    cloud = lambda at, n: np.column_stack([r.normal(at, 1, (n, 2)), np.zeros((n, quality_model.SIZE - 2))])
    w, b = quality_model.descend(cloud(2, 300), np.vstack([cloud(2, 500), cloud(-2, 500)]), 0.5, 300, 1e-3, 0.05)
    assert (cloud(2, 200) @ w + b > 0).mean() > 0.95 and (cloud(-2, 200) @ w + b < 0).mean() > 0.95


def test_toxicity_score_is_the_plain_sum():
    """A score is the sigmoid of the intercept and the weights of the distinct n-grams of characters, each counted once."""
    import numpy as np

    grams, text = classify.Grams(toxicity.SIZES, toxicity.BITS), "Añb añB bad BAD"
    number = lambda g: int(grams.hashes(grams.characters(np.frombuffer(g.encode(), np.uint8), np.array([0, len(g.encode())]))[0])[len(g) - 3][0])
    lowered = text.translate(LOWER)
    every = sorted({lowered[i : i + n] for n in toxicity.SIZES for i in range(len(lowered) - n + 1)})
    weights = np.zeros(1 << toxicity.BITS)
    for i, g in enumerate(every):
        weights[number(g)] = (i % 7 - 3) / 10
    want = 1 / (1 + math.exp(-sum(weights[k] for k in {number(g) for g in every}) - 0.25))
    raw = np.frombuffer(text.encode(), np.uint8)
    assert toxicity.Model(weights, 0.25).scores(raw, np.array([0, len(raw)]))[0] == pytest.approx(want, abs=1e-6)
