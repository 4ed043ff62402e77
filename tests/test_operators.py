"""Hand-computed cases and properties of operators."""

import math

import pytest
from pyspark.sql import functions as F

from lectern.functions import items as I
from lectern.functions import strings as S
from lectern.operators import groundtruth, metrics, relational, scoring, search
from lectern.plans import retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("{ 1 0 8 }", "108"),
        ("0 . 5", "0.5"),
        (r"\overline { A B }", r"\overline{AB}"),
        (r"\cfrac { 1 } { 2 }", r"\cfrac{1}{2}"),
        (r"\angle A B C = 6 0 \degree", "∠ABC = 60°"),
        ("2 a + 3 x", "2a + 3x"),
        ("x ^ { 2 }", "x ^{2}"),
        ("", ""),
    ],
)
def test_latex(spark, raw, clean):
    assert one(spark, S.clean_latex(F.lit(raw))) == clean


def test_latex_spans(spark):
    assert one(spark, S.clean_spans(F.lit("a $1 0$ b $2 0"))) == "a $10$ b $2 0"


@pytest.mark.parametrize(("text", "single", "many", "rest"), [("3", 3, [], ""), ("1,3", None, [1, 3], ""), ("7", None, [], "7"), ("1, x", None, [1], ""), ("1,9", None, [], "1,9"), (None, None, [], "")])
def test_answers(spark, text, single, many, rest):
    c = F.lit(text).cast("string")
    assert one(spark, I.single_answer(c)) == single
    assert one(spark, I.answer_list(c)) == many
    assert one(spark, I.answer_text(c)) == rest


@pytest.mark.parametrize(("level", "code", "name"), [("01", "03", "초3"), ("02", "08", "중2"), ("02", "02", "중2"), ("03", "12", "고3"), ("", "11", "고2"), ("02", "05", ""), ("01", None, "")])
def test_grades(spark, level, code, name):
    assert one(spark, I.grade_name(F.lit(level), F.lit(code).cast("string"))) == name


@pytest.mark.parametrize(("raw", "subject", "grade", "difficulty", "kind"), [("03", "수학", "초3", "hard", ""), ("수학 심화", "수학", "", "medium", ""), ("11", "미술", "고2", "medium", "선택형"), (None, "수학", "", "medium", ""), ("02 중", "영어", "초2", "medium", ""), ("중3", "수학", "중3", "medium", "")])
def test_normaliser(spark, raw, subject, grade, difficulty, kind):
    c = F.lit(raw).cast("string")
    m = one(spark, I.normal_metadata(c, c, c, c))
    assert (m.subject, m.grade, m.difficulty, m.question_type) == (subject, grade, difficulty, kind)
    assert m.school_level == {"초": "초등학교", "중": "중학교", "고": "고등학교"}.get(grade[:1], "")


def test_safety_rules_and_modes(spark):
    """Every rule family has a sentence in the registered query; medium bias counts in strict mode only."""
    from lectern.operators import quality
    from lectern.plans.checks import PLANTED

    assert {h[1] for _, hits in PLANTED for h in hits} == {r[1] for r in quality.SAFETY_RULES} and len(quality.SAFETY_RULES) == 14
    texts = spark.createDataFrame([(1, "요즘 꼰대 이야기"), (2, None), (3, "카지노")], "id long, text string")
    of = lambda strict: {(r.id, r.family, r.status) for r in quality.screen(texts, strict=strict).collect()}
    assert of(True) == {(1, "age", "FAIL"), (3, "gambling", "FAIL")} and of(False) == {(3, "gambling", "FAIL")}


def test_entity_modes(spark):
    assert [one(spark, S.verification_mode(F.lit(x).cast("string"))) for x in ("history", "math", "art", None)] == ["strict", "skip", "moderate", "moderate"]
    assert one(spark, S.entities(F.lit("2001년 5월 7일, 1999년"), "date")) == ["200157"] and one(spark, S.entities(F.lit("2001 1999년"), "year")) == ["1999"]


@pytest.mark.parametrize(("text", "json"), [('{"a":1}', '{"a":1}'), ('x ```json\n{"a":2}\n``` y', '{"a":2}'), ("it is {\"a\":3}.", '{"a":3}'), ("none", None), (None, None)])
def test_json(spark, text, json):
    assert one(spark, S.recovered_json(F.lit(text).cast("string"))) == json


def test_metrics_by_hand(spark):
    truth = spark.createDataFrame([(1, 10, 3), (1, 20, 2), (1, 30, 1)], "query_id long, item_id long, relevance int")
    ranked = spark.createDataFrame([(1, i, r) for r, i in enumerate([90, 10, 91, 30, 20], 1)], "query_id long, item_id long, rank int")
    m = metrics.per_query(ranked, truth).head()
    assert m.recall_3 == pytest.approx(1 / 3, abs=1e-6)
    assert (m.hit_1, m.rr) == (0.0, 0.5)
    assert m.ap == pytest.approx((1 / 2 + 2 / 4 + 3 / 5) / 3, abs=1e-6)
    gain = 3 / math.log2(3) + 1 / math.log2(5) + 2 / math.log2(6)
    assert m.ndcg_5 == pytest.approx(gain / (3 + 2 / math.log2(3) + 1 / 2), abs=1e-6)


def test_metric_properties(spark, sf):
    m = metrics.per_query(search.knn(*retrieval.vectors(spark, sf), 20), retrieval.truth(spark, sf)).collect()
    for r in m:
        recalls = [r[f"recall_{k}"] for k in metrics.CUTS]
        assert recalls == sorted(recalls)
        assert all(0 <= r[c] <= 1 for c in ("rr", "ap", "ndcg_5", "ndcg_20"))


def test_blocked_knn_equals_pairs(spark, sf):
    q, c = retrieval.vectors(spark, sf)
    blocked = search.knn(q, c, 7, block=3, group=20, pivots=9)
    plain = search.best(search.cosine_pairs(q, c), 7)
    key = lambda df: sorted((r.query_id, r.rank, r.item_id, r.score) for r in df.collect())
    assert key(blocked) == key(plain)


def test_knn_defined_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0]), (5, None), (6, [1.0, 0.0])]
    c = spark.createDataFrame(rows, "item_id long, embedding array<float>")
    found = search.knn(c.where("item_id = 1").withColumnRenamed("item_id", "query_id"), c, 3).orderBy("rank").collect()
    assert [(r.item_id, r.score) for r in found] == [(3, 1.0), (6, 1.0), (2, 0.0)]
    assert search.knn(c.limit(0).withColumnRenamed("item_id", "query_id"), c, 3).count() == 0


def test_approximate_recall(spark, sf):
    q, c = retrieval.vectors(spark, sf)
    exact = {(r.query_id, r.item_id) for r in search.knn(q, c, 10).collect()}
    near = {(r.query_id, r.item_id) for r in search.approximate_knn(q, c, 10).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_fusion_alpha_one_is_dense(spark, sf):
    q, c = retrieval.hybrid_inputs(spark, sf)
    dense = search.knn(q, c, 20)
    fused = search.fuse(dense, search.bm25(q, c), [1.0])
    key = lambda df: sorted((r.query_id, r.rank, r.item_id) for r in df.collect())
    assert key(fused) == key(dense)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "id int, seq int, v string")
    new = spark.createDataFrame([(2, 1, "c"), (2, 2, "d"), (3, 1, "e")], "id int, seq int, v string")
    once = relational.upsert(old, new, "id", "seq")
    assert sorted(map(tuple, once.collect())) == [(1, 0, "a"), (2, 2, "d"), (3, 1, "e")]
    assert sorted(map(tuple, relational.upsert(once, new, "id", "seq").collect())) == sorted(map(tuple, once.collect()))


def test_stratified_quotas(spark):
    rows = spark.createDataFrame([(s, g, f"{s}{g}{i}") for s in "abc" for g in range(4) for i in range(5)], "subject string, grade int, id string")
    assert relational.stratified(rows, ["subject", "grade"], "id", 3).count() == 36
    assert relational.stratified(rows, ["subject", "grade"], "id", 30).count() == 60


def test_symmetric_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "a int, b int")
    found = {tuple(r) for r in groundtruth.symmetric(e, "a", "b").collect()}
    assert found == {(b, a) for a, b in found} and len(found) == 4


@pytest.mark.parametrize(("value", "correct", "kind", "ok"), [(["A"], ["a"], "single", True), (["b", "a"], ["A", "B"], "multiple", True), (["b", "a"], ["A", "B"], "ordered", False), (["a", "b", "c"], ["A", "B"], "multiple", False), (None, ["A"], "single", False), (["a"], [], "single", False)])
def test_scoring(spark, value, correct, kind, ok):
    row = spark.createDataFrame([(value, correct, kind)], "v array<string>, c array<string>, k string")
    assert row.select(scoring.is_correct(F.col("v"), F.col("c"), F.col("k"))).head()[0] is ok


def test_leaves(spark):
    rows = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"]), (4, ["x"])], "id int, path array<string>")
    assert {r.id: r.is_leaf for r in relational.leaves(rows, "id", "path").collect()} == {1: False, 2: False, 3: True, 4: True}
