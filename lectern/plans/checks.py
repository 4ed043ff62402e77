"""Quality rules and response scoring on columns derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import items as I
from lectern.functions import strings as S
from lectern.functions.images import image_header
from lectern.operators import quality as Q
from lectern.operators import scoring
from lectern.plans.normalise import ATTR_SQL, attrs
from lectern.plans.registry import register
from lectern.session import scratch, table


def joined(c):
    return F.array_join(c, ";")


@register("q1_preprocess_validation", f"""WITH {ATTR_SQL}, e AS (SELECT doc_id, concat_ws(';', CASE WHEN n_chars % 11 = 0 THEN 'missing_question' END, CASE WHEN starts_with(kind, '11') AND doc_id % 3 = 0 THEN 'missing_choices' END,
CASE WHEN starts_with(kind, '11') AND (doc_id % 8 < 1 OR doc_id % 8 > 5) THEN 'invalid_answer_range' END, CASE WHEN doc_id % 4 = 1 THEN 'missing_images' END) AS errors FROM a) SELECT doc_id, errors, errors = '' AS is_valid FROM e""")
def q1(spark: SparkSession, sf: str) -> DataFrame:
    a = attrs(spark, sf)
    none = F.array().cast("array<string>")
    errors = Q.preprocess_errors(F.col("doc_id"), F.when(F.col("n_chars") % 11 == 0, "").otherwise(F.col("text")), F.col("kind").startswith("11"), F.when(F.col("doc_id") % 3 == 0, none).otherwise(F.array("lang")), F.col("doc_id") % 8, F.when(F.col("doc_id") % 4 == 1, F.array("image")).otherwise(none))
    return a.select("doc_id", errors.alias("e")).select("doc_id", joined("e").alias("errors"), (F.size("e") == 0).alias("is_valid"))


@register("q2_metadata_validation", f"""WITH {ATTR_SQL} SELECT doc_id, concat_ws(';', CASE WHEN difficulty = '' THEN 'missing_metadata_difficulty' END, CASE WHEN kind = '' THEN 'missing_metadata_kind' END,
CASE WHEN difficulty NOT IN ('', '01', 'middle') THEN 'invalid_difficulty:' || difficulty END, CASE WHEN kind NOT IN ('', '21', '11 choice') THEN 'invalid_kind:' || kind END,
CASE WHEN regexp_full_match(year_text, '[0-9]+') AND CAST(CASE WHEN regexp_full_match(year_text, '[0-9]+') THEN year_text END AS INTEGER) NOT BETWEEN 2000 AND 2030 THEN 'invalid_year:' || year_text END) AS errors FROM a""")
def q2(spark: SparkSession, sf: str) -> DataFrame:
    d, k = F.col("difficulty"), F.col("kind")
    errors = Q.metadata_errors({"difficulty": d, "kind": k}, {"difficulty": (d, ["01", "middle"]), "kind": (k, ["21", "11 choice"])}, I.year_of(F.col("year_text")))
    return attrs(spark, sf).select("doc_id", joined(errors).alias("errors"))


@register("q3_content_validation", """WITH c AS (SELECT doc_id, doc_id % 2 = 0 AS choice, CAST(doc_id % 7 AS INTEGER) AS n, CAST(doc_id % 9 AS INTEGER) AS ans, CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 1 THEN 'ab' ELSE text END AS q FROM documents)
SELECT doc_id, concat_ws(';', CASE WHEN q = '' THEN 'empty_question' END, CASE WHEN q <> '' AND length(q) < 5 THEN 'question_too_short' END, CASE WHEN choice AND n = 0 THEN 'no_choices' END, CASE WHEN choice AND n BETWEEN 1 AND 3 THEN 'insufficient_choices:' || n END,
CASE WHEN choice AND n > 5 THEN 'too_many_choices:' || n END, CASE WHEN choice AND ans = 0 THEN 'missing_answer' END, CASE WHEN choice AND ans > n THEN 'answer_out_of_range:' || ans END, CASE WHEN choice AND n >= 3 AND doc_id % 5 = 0 THEN 'empty_choices:[3]' END,
CASE WHEN NOT choice AND doc_id % 3 = 0 THEN 'missing_answer_text' END, CASE WHEN doc_id % 6 = 0 THEN 'unbalanced_braces_in_latex:1' END) AS errors FROM c""")
def q3(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 10 == 0, "").when(F.col("doc_id") % 10 == 1, "ab").otherwise(F.col("text")).alias("q"),
        F.transform(F.slice(F.array(*[F.lit(i) for i in range(1, 8)]), 1, (F.col("doc_id") % 7).cast("int")), lambda i: F.when((i == 3) & (F.col("doc_id") % 5 == 0), "  ").otherwise(F.concat(F.lit("c"), i.cast("string")))).alias("choices"),
        F.filter(F.array((F.col("doc_id") % 9).cast("int")), lambda x: x > 0).alias("answers"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise("x").alias("answer_text"),
        F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("{a}"), F.lit("{b"))).otherwise(F.array(F.lit("{a}"))).alias("latex"),
    )
    return d.select("doc_id", joined(Q.content_errors(F.col("q"), F.col("doc_id") % 2 == 0, F.col("choices"), F.col("answers"), F.col("answer_text"), F.col("latex"))).alias("errors"))


@register("q4_image_validation", f"""WITH {ATTR_SQL} SELECT doc_id, concat_ws(';', CASE WHEN image = '' THEN 'empty_image_path' ELSE concat_ws(';', CASE WHEN contains(image, chr(92)) THEN 'windows_path_format:' || substr(image, 1, 30) END,
CASE WHEN doc_id % 4 = 2 THEN 'invalid_image_extension:.txt' END, CASE WHEN doc_id % 3 <> 0 THEN 'image_not_found:' || substr(image, 1, 50) END) END, CASE WHEN doc_id % 3 <> 0 THEN 'missing_images_count:1' END) AS errors FROM a""")
def q4(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    has = F.col("doc_id") % 3 == 0
    e = Q.image_errors(F.array("image"), F.when(has, F.array("image")).otherwise(none), F.when(has, none).otherwise(F.array("image")))
    return attrs(spark, sf).select("doc_id", joined(e).alias("errors"))


@register("q5_consistency", """SELECT doc_id, concat_ws(';', CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'image_placeholder_without_image' END, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 <> 0 THEN 'image_without_placeholder' END, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 <> 0 THEN 'explanation_image_placeholder_without_image' END) AS errors FROM documents""")
def q5(spark: SparkSession, sf: str) -> DataFrame:
    mark = lambda m: F.when(F.col("doc_id") % m == 0, F.concat("source", F.lit(" [이미지]"))).otherwise(F.col("source"))
    images = lambda m: F.when(F.col("doc_id") % m == 0, F.array("source")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", joined(Q.consistency_errors(mark(2), images(3), mark(5), images(7))).alias("errors"))


CHOICES = "p_name || '|' || p_brand || '|' || p_type || '|' || CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN upper(p_type) ELSE 'x' END"


@register("q6_item_quality", f"""WITH c AS (SELECT p_partkey, p_partkey % 3 = 0 AS short, string_split({CHOICES}, '|') AS ch, p_partkey % 6 AS k, p_partkey % 5 AS ev FROM part),
r AS (SELECT p_partkey, concat_ws(',', CASE WHEN short OR len(list_filter(ch, lambda x: trim(x) = '')) > 0 OR k NOT BETWEEN 1 AND 4 THEN 'INVALID_FORMAT' END, CASE WHEN len(list_distinct(list_transform(ch, lambda x: lower(trim(x))))) < len(ch) THEN 'OPTION_OVERLAP' END) AS codes, ev FROM c)
SELECT p_partkey, codes, CASE WHEN codes <> '' THEN 'FAIL' WHEN ev = 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM r""")
def q6(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN 'short' ELSE 'a long enough stem' END AS stem", f"split({CHOICES}, '[|]') AS choices")
    found, status = Q.item_check(F.col("stem"), F.array(*[F.lit(str(i)) for i in range(1, 5)]), F.col("choices"), (F.col("p_partkey") % 6).cast("string"), F.lit("an explanation of some length"), F.col("p_partkey") % 5 != 0)
    return p.select("p_partkey", F.array_join(found, ",").alias("codes"), status.alias("status"))


# One sentence for each family of safety rules, with what is found in it, and two that break none or two.
PLANTED = [
    ("평범한 문장", []), ("여자는 수학을 못한다", [("bias", "gender", "high", "여자는 수학을 못")]), ("경상 사람은 거칠다", [("bias", "region", "high", "경상 사람은 거칠")]), ("요즘 꼰대 이야기", [("bias", "age", "medium", "꼰대")]),
    ("정신 이상 증세", [("bias", "disability", "high", "정신 이상")]), ("불교는 미신이다", [("bias", "religion", "high", "불교는 미신")]), ("다문화 문제", [("bias", "nationality", "high", "다문화 문제")]), ("잔인하게 말했다", [("inappropriate", "violence", "high", "잔인하게")]),
    ("ㅂㅅ 이라고 썼다", [("inappropriate", "profanity", "high", "ㅂㅅ")]), ("음란 사이트", [("inappropriate", "sexual", "high", "음란")]), ("카지노 방문", [("inappropriate", "gambling", "medium", "카지노")]), ("대마초 재배", [("inappropriate", "drugs", "high", "대마초")]),
    ("정치인 비판 기사", [("sensitive", "political", "medium", "정치인 비판")]), ("극단적  선택", [("sensitive", "suicide", "high", "극단적  선택")]), ("1980년대 민주화", [("inappropriate", "profanity", "high", "년"), ("sensitive", "historical_controversy", "medium", "민주화")]),
]


def _status(group: str, level: str) -> tuple[str, str]:
    if group == "sensitive" and level == "medium":
        return "", "REVIEW"
    return ("BIAS_DETECTED" if group == "bias" else "SAFETY_VIOLATION"), "FAIL"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# The fixed rules as SQL: each family's first pattern that is found in a document with its sentence behind it. \s of RE2 has no vertical tab, that of Spark has one.
SAFETY_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_quoted(group)}, {_quoted(family)}, {_quoted(level)}, {rank}, {_quoted('(?i)' + pattern.replace(chr(92) + 's', '[' + chr(92) + 's' + chr(92) + 'x0B]'))}, {_quoted(_status(group, level)[0])}, {_quoted(_status(group, level)[1])})"
    for group, family, level, patterns in Q.SAFETY_RULES for rank, pattern in enumerate(patterns)
) + ') v("group", family, level, rank, pattern, code, status))'
SENTENCES = ", ".join(f"({k}, {_quoted(t)})" for k, (t, _) in enumerate(PLANTED))


@register("q7_safety_screen", f"""WITH {SAFETY_SQL}, d AS (SELECT doc_id AS id, coalesce(text, '') || ' . ' || sentence AS text FROM documents JOIN (VALUES {SENTENCES}) s(k, sentence) ON doc_id % {len(PLANTED)} = k),
h AS (SELECT id, "group", family, level, substr(regexp_extract(text, pattern, 0), 1, 50) AS matched, code, status, row_number() OVER (PARTITION BY id, "group", family ORDER BY rank) AS n FROM d JOIN rules ON regexp_matches(text, pattern))
SELECT id, "group", family, level, matched, code, status FROM h WHERE n = 1""")
def q7(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with one of the sentences behind its text."""
    sentence = F.element_at(F.array(*[F.lit(t) for t, _ in PLANTED]), (F.col("doc_id") % len(PLANTED) + 1).cast("int"))
    return Q.screen(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" . "), sentence).alias("text")))


# Rules of another language, as a file of its own: (group, family, level, rank, pattern).
RULES = [("bias", "insult", "high", 1, "(idiot|moron)"), ("bias", "insult", "high", 2, "(clown)"), ("bias", "contempt", "medium", 1, "(worthless|trash)"), ("sensitive", "licence", "medium", 1, "(MIT|Apache) Licen[cs]e")]
RULE_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in RULES) + ') v("group", family, level, rank, pattern))'


@register("q7_rules_of_a_file", f"""WITH {RULE_SQL}, h AS (SELECT d.doc_id AS id, "group", family, level, substr(regexp_extract(d.text, '(?i)' || pattern, 0), 1, 50) AS matched, row_number() OVER (PARTITION BY d.doc_id, family ORDER BY rank) AS n FROM documents d JOIN rules ON regexp_matches(d.text, '(?i)' || pattern))
SELECT id, "group", family, level, matched, CASE WHEN "group" = 'bias' THEN 'BIAS_DETECTED' ELSE '' END AS code, CASE WHEN "group" = 'bias' THEN 'FAIL' ELSE 'REVIEW' END AS status FROM h WHERE n = 1 AND NOT ("group" = 'bias' AND level = 'medium')""")
def q7b(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "rules")
    spark.createDataFrame(RULES, "`group` string, family string, level string, rank int, pattern string").write.json(path)
    return Q.screen(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), Q.read_rules(spark, path), strict=False)


@register("q8_gender_balance", """WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS s FROM conversations GROUP BY conv_id) SELECT conv_id, u + s >= 3 AND (u = 0 OR s = 0) AS unbalanced FROM c""")
def q8(spark: SparkSession, sf: str) -> DataFrame:
    named = lambda p: F.count_if(F.col("role").rlike(p))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(Q.unbalanced(named("^user$"), named("^assistant$")).alias("unbalanced"))


@register("q9_calculation_check", """WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS a, l_linenumber AS b, CAST(l_quantity AS INTEGER) + l_linenumber + CASE WHEN l_orderkey % 3 = 0 THEN 5 ELSE 0 END AS keyed, l_orderkey % 7 = 0 AS bad, l_orderkey % 5 = 0 AS dup FROM lineitem),
r AS (SELECT *, concat_ws(',', CASE WHEN dup OR keyed = 1000 THEN 'OPTION_OVERLAP' END, CASE WHEN bad THEN 'CALCULATION_ERROR' END) AS codes FROM c)
SELECT l_orderkey, l_linenumber, codes, CASE WHEN codes <> '' THEN 'FAIL' WHEN abs(a + b - keyed) > greatest(keyed * 0.01, 0.001) THEN 'REVIEW' ELSE 'PASS' END AS status FROM r""")
def q9(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    keyed = (a + b + F.when(F.col("l_orderkey") % 3 == 0, 5).otherwise(0)).cast("string")
    choices = F.array(keyed, F.lit("1000"), F.when(F.col("l_orderkey") % 5 == 0, "1000.0 kg").otherwise("none"))
    explanation = F.concat(F.lit("We add "), a.cast("string"), F.lit(" + "), b.cast("string"), F.lit("."))
    found, status = Q.calculation_check(F.lit("Sum?"), explanation, F.array(F.lit("A"), F.lit("B"), F.lit("C")), choices, F.when(F.col("l_orderkey") % 7 == 0, "Z").otherwise("A"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(found, ",").alias("codes"), status.alias("status"))


REPORT = "CASE WHEN l_discount < 0.03 THEN 'FAIL' WHEN l_discount < 0.05 THEN 'REVIEW' ELSE 'PASS' END AS status, CASE WHEN l_discount < 0.01 THEN 'SAFETY_VIOLATION' WHEN l_discount < 0.02 THEN 'INVALID_FORMAT' WHEN l_discount < 0.03 THEN CASE WHEN l_tax > 0.04 THEN 'OPTION_OVERLAP' ELSE 'CALCULATION_ERROR' END ELSE '' END AS code"


@register("q10_status_fusion", f"""WITH r AS (SELECT l_orderkey AS item_id, {REPORT} FROM lineitem), g AS (SELECT item_id, coalesce(string_agg(DISTINCT code, ',' ORDER BY code) FILTER (code <> ''), '') AS codes, bool_or(status = 'FAIL') AS failed, bool_and(status = 'PASS') AS passed FROM r GROUP BY item_id)
SELECT item_id, codes, CASE WHEN contains(codes, 'SAFETY_VIOLATION') THEN 'REJECT' WHEN failed AND codes <> '' AND NOT contains(codes, 'OPTION_OVERLAP') THEN 'RETRY' WHEN failed THEN 'REJECT' WHEN passed THEN 'PASS' ELSE 'RETRY' END AS final_status FROM g""")
def q10(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "lineitem").selectExpr("l_orderkey AS item_id", REPORT.split(", CASE WHEN l_discount < 0.01")[0], "CASE WHEN l_discount < 0.01" + REPORT.split(", CASE WHEN l_discount < 0.01")[1])
    r = r.select("item_id", "status", F.filter(F.array("code"), lambda c: c != "").alias("failure_codes"))
    return Q.final_status(r).select("item_id", F.array_join("codes", ",").alias("codes"), "final_status")


@register("q11_judge_consensus", """WITH v AS (SELECT user_id AS item_id, event_type <> 'view' AS is_valid, value AS q, event_type = 'error' AS err FROM events), g AS (SELECT item_id, count(*) FILTER (NOT err) AS active, count(*) FILTER (NOT err AND is_valid) AS ok, count(*) FILTER (NOT err AND NOT is_valid) AS bad, round(coalesce(avg(q) FILTER (NOT err), 0), 6) AS mean_quality FROM v GROUP BY item_id)
SELECT item_id, active, mean_quality, CASE WHEN active = 0 THEN 'REVIEW' WHEN ok > bad THEN 'PASS' WHEN bad > ok THEN 'FAIL' ELSE 'REVIEW' END AS majority, CASE WHEN active = 0 THEN 'REVIEW' WHEN bad > 0 THEN 'FAIL' WHEN ok = active THEN 'PASS' ELSE 'REVIEW' END AS unanimous FROM g""")
def q11(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "events").select(F.col("user_id").alias("item_id"), (F.col("event_type") != "view").alias("is_valid"), F.col("value").alias("quality_score"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return Q.consensus(v, False).withColumnRenamed("status", "majority").join(Q.consensus(v, True).select("item_id", F.col("status").alias("unanimous")), "item_id")


@register("q12_verdict_parsing", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'REVIEW' END AS verdict, CASE WHEN value >= 0.7 THEN 'PASS' WHEN value >= 0.5 THEN 'REVIEW' ELSE 'FAIL' END AS image_verdict FROM events")
def q12(spark: SparkSession, sf: str) -> DataFrame:
    forms = """CASE event_id % 4 WHEN 0 THEN '```json {"is_valid": true, "n": ' || event_id || '} ```' WHEN 1 THEN 'Well: {"is_valid": false, "failure_codes": ["X' || event_id || '"]}' WHEN 2 THEN '{"is_valid": false}' ELSE 'no json ' || event_id END AS answer"""
    return table(spark, sf, "events").selectExpr("event_id", "value", forms).select("event_id", Q.verdict(F.col("answer")).alias("verdict"), Q.image_consistency(F.col("value")).alias("image_verdict"))


ROUTES = [("AUTOMOBILE", "quality,consistency,calc", 1), ("BUILDING", "quality,consistency,fact", 2), ("FURNITURE", "quality,safety", 3)]
ROUTE_SQL = "routes AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in ROUTES) + ") v(subject, validators, judges))"


@register("q13_validator_routing", f"WITH {ROUTE_SQL} SELECT c_custkey, coalesce(validators, 'quality,consistency') AS validators, CAST(coalesce(judges, 1) AS INTEGER) AS judges, contains(coalesce(validators, ''), 'calc') AS calc, contains(coalesce(validators, ''), 'safety') AS safety FROM customer LEFT JOIN routes ON c_mktsegment = subject")
def q13(spark: SparkSession, sf: str) -> DataFrame:
    routes = spark.createDataFrame(ROUTES, "subject string, validators string, judges int")
    v = F.split(F.coalesce("validators", F.lit("quality,consistency")), ",")
    j = table(spark, sf, "customer").join(F.broadcast(routes), F.col("c_mktsegment") == F.col("subject"), "left")  # a fixed table of a few rows
    return j.select("c_custkey", F.array_join(v, ",").alias("validators"), F.coalesce("judges", F.lit(1)).alias("judges"), F.array_contains(v, "calc").alias("calc"), F.array_contains(v, "safety").alias("safety"))


@register("q19_document_schema", "SELECT page_id, concat_ws(';', CASE WHEN NOT contains(html, '<html') THEN 'missing_root' END, CASE WHEN NOT contains(html, 'lang=') THEN 'missing_lang' END, CASE WHEN NOT contains(html, '<title>') THEN 'missing_title' END, CASE WHEN NOT contains(html, '<p>') THEN 'missing_body' END) AS errors FROM pages")
def q19(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", joined(Q.codes((~h.contains("<html"), "missing_root"), (~h.contains("lang="), "missing_lang"), (~h.contains("<title>"), "missing_title"), (~h.contains("<p>"), "missing_body"))).alias("errors"))


IMAGE_SIZES = "i AS (SELECT doc_id, n_chars % 5000 AS w, length(coalesce(text, '')) * 7 % 4500 AS h, doc_id % 6 AS k, n_chars * 9000 AS size FROM documents)"


def image_files(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, path, size, content): the first bytes of image files in turn PNG, GIF, BMP, JPEG, a broken PNG and none at all, as wide and high as columns say."""
    w, h, k = F.col("n_chars") % 5000, F.length(F.coalesce("text", F.lit(""))) * 7 % 4500, F.col("doc_id") % 6
    big = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    little = lambda c, n: F.concat(*[F.substring(big(c, n), 2 * i + 1, 2) for i in reversed(range(n))])
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), little(w, 2), little(h, 2), F.lit("F70000"))
    bmp = F.concat(F.lit("424D"), F.lit("00" * 12), F.lit("28000000"), little(w, 4), little(h, 4), F.lit("01001800"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFDB0043"), F.lit("11" * 65), F.lit("FFC00011"), F.lit("08"), big(h, 2), big(w, 2), F.lit("03012200"))
    digits = F.when(k == 0, png).when(k == 1, gif).when(k == 2, bmp).when(k == 3, jpeg).when(k == 4, F.substring(png, 1, 36))
    name = F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.when(k == 1, ".gif").when(k == 2, ".bmp").when(k == 3, ".JPG").otherwise(".png"))
    return table(spark, sf, "documents").select("doc_id", name.alias("path"), F.when(k < 5, F.col("n_chars") * 9000).alias("size"), F.unhex(digits).alias("content"))


@register("q20_image_files", f"""WITH {IMAGE_SIZES} SELECT doc_id, CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'gif' WHEN 2 THEN 'bmp' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'png' END AS kind, CASE WHEN k < 4 THEN w END AS width, CASE WHEN k < 4 THEN h END AS height,
concat_ws(';', CASE WHEN k = 5 THEN 'not_found' END, CASE WHEN k = 4 THEN 'unreadable' END, CASE WHEN k < 4 AND least(w, h) < 200 THEN 'too_small' END, CASE WHEN k < 4 AND greatest(w, h) > 4096 THEN 'too_large' END, CASE WHEN k < 5 AND size > 20971520 THEN 'file_too_big' END) AS errors FROM i""")
def q20(spark: SparkSession, sf: str) -> DataFrame:
    files = image_files(spark, sf).withColumn("head", image_header(F.col("content")))
    return files.select("doc_id", "head.*", joined(Q.image_file_errors(F.col("path"), F.col("size"), F.col("head"))).alias("errors"))


FACTS = """o AS (SELECT o_orderkey AS item_id, o_orderdate AS d, CASE WHEN starts_with(o_orderpriority, '1') THEN 'strict' WHEN starts_with(o_orderpriority, '2') THEN 'skip' ELSE 'moderate' END AS mode FROM orders),
y AS (SELECT DISTINCT year(l_shipdate) AS y, CASE WHEN year(l_shipdate) % 2 = 0 THEN 'verified' ELSE 'failed' END AS outcome FROM lineitem WHERE year(l_shipdate) <> 1997),
f AS (SELECT item_id, 'year' AS kind, CAST(year(d) AS VARCHAR) AS value, coalesce(outcome, 'unknown') AS outcome FROM o LEFT JOIN y ON year(d) = y.y WHERE mode <> 'skip'
UNION ALL SELECT item_id, 'date', year(d) || '' || month(d) || day(d), 'unknown' FROM o WHERE mode <> 'skip'
UNION ALL SELECT item_id, kind, value, outcome FROM o, (VALUES ('person', '이순신', 'verified'), ('event', '임진전쟁', 'verified'), ('place', '부산시', 'unknown'), ('place', '강원도', 'verified'), ('place', '진주군', 'unknown')) v(kind, value, outcome) WHERE mode <> 'skip')"""


def fact_items(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, text, mode): four places, of which three count, a person, an event, a date and its year."""
    text = F.concat(F.date_format("o_orderdate", "yyyy년 M월 d일"), F.lit(" 이순신은 부산시 앞 임진전쟁 뒤 강원도 / 진주군 / 한산면"))
    subject = F.when(F.col("o_orderpriority").startswith("1"), "history").when(F.col("o_orderpriority").startswith("2"), "math").otherwise("science")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), text.alias("text"), S.verification_mode(subject).alias("mode"))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    year = F.year("l_shipdate")
    known = table(spark, sf, "lineitem").select(year.alias("y")).distinct().where("y <> 1997").select(F.lit("year").alias("kind"), F.col("y").cast("string").alias("value"), F.when(F.col("y") % 2 == 0, "verified").otherwise("failed").alias("outcome"))
    named = spark.createDataFrame([("person", "이순신", "verified"), ("event", "임진전쟁", "verified"), ("place", "강원도", "verified"), ("place", "한산면", "failed")], "kind string, value string, outcome string")
    return Q.entity_facts(fact_items(spark, sf), known.unionByName(named))


@register("j14_entity_verification", f"WITH {FACTS} SELECT item_id, kind, value, outcome FROM f")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf)


@register("q21_fact_verdict", f"""WITH {FACTS}, g AS (SELECT o.item_id, any_value(mode) AS mode, count(*) FILTER (outcome = 'verified') AS verified, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'unknown') AS unknown FROM o LEFT JOIN f ON f.item_id = o.item_id GROUP BY o.item_id)
SELECT item_id, verified, failed, unknown, CASE WHEN failed > 0 THEN 'FAIL' WHEN mode = 'strict' AND unknown > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM g""")
def q21(spark: SparkSession, sf: str) -> DataFrame:
    return Q.fact_verdict(facts(spark, sf), fact_items(spark, sf).select("item_id", "mode"))


ANSWER = "CASE l_linenumber % 4 WHEN 0 THEN l_returnflag WHEN 1 THEN lower(l_returnflag) || ' |' || l_linestatus WHEN 2 THEN l_linestatus || '|' || l_returnflag ELSE NULL END"
KIND = "CASE WHEN l_orderkey % 3 = 0 THEN 'ordered' WHEN l_orderkey % 3 = 1 THEN 'multiple' ELSE 'single' END"


def responses(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"split({ANSWER}, '[|]') AS value", "CASE WHEN l_orderkey % 3 = 2 THEN array('A') ELSE array('A', l_linestatus) END AS correct", f"{KIND} AS cardinality")
    return r


@register("q14_response_scoring", f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_transform(string_split({ANSWER}, '|'), lambda x: lower(trim(x))) AS v, CASE WHEN l_orderkey % 3 = 2 THEN ['a'] ELSE ['a', lower(l_linestatus)] END AS c, {KIND} AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE k WHEN 'ordered' THEN v = c WHEN 'multiple' THEN list_sort(list_distinct(v)) = list_sort(list_distinct(c)) ELSE v[1] = c[1] END, false) AS correct FROM r""")
def q14(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scoring.is_correct(F.col("value"), F.col("correct"), F.col("cardinality")).alias("correct"))


@register("q17_partial_credit", f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(list_transform(string_split({ANSWER}, '|'), lambda x: lower(trim(x))), []) AS v, CASE WHEN l_orderkey % 3 = 2 THEN ['a'] ELSE ['a', lower(l_linestatus)] END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(len(list_filter(v, lambda x: list_contains(c, x))) / len(c), 6) AS credit FROM r""")
def q17(spark: SparkSession, sf: str) -> DataFrame:
    value = F.coalesce("value", F.array().cast("array<string>"))
    return responses(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(scoring.partial_credit(value, F.col("correct")), 6).alias("credit"))


@register("q15_mapped_scoring", """WITH r AS (SELECT event_id, event_type, value FROM events), m AS (SELECT * FROM (VALUES ('click', 2.0), ('VIEW', 1.5), ('purchase', 9.0), ('error', -4.0)) v(key, mapped)),
s AS (SELECT r.event_id, event_type = 'signup' AS none, 0.5 + coalesce(m.mapped, 0) AS total FROM r LEFT JOIN m ON lower(m.key) = r.event_type)
SELECT event_id, CAST(CASE WHEN none THEN 0.0 ELSE greatest(-1.0, least(5.0, total)) END AS DOUBLE) AS score, CASE WHEN none THEN 0.0 ELSE greatest(-1.0, least(5.0, total)) END >= 5.0 AS correct FROM s""")
def q15(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "events").select("event_id", F.lit(1).alias("item_id"), F.when(F.col("event_type") != "signup", F.array("event_type")).alias("value"), F.lit(-1.0).alias("lower"), F.lit(5.0).alias("upper"), F.lit(0.5).alias("default"))
    entries = spark.createDataFrame([(1, "click", 2.0, True), (1, "VIEW", 1.5, False), (1, "purchase", 9.0, False), (1, "error", -4.0, True)], "item_id int, key string, mapped double, case_sensitive boolean")
    return scoring.mapped(r, entries, ["event_id"])


@register("q16_item_rollup", """WITH s AS (SELECT user_id, event_type, count(*) AS n, max(value) > 100 AS ok FROM events GROUP BY 1, 2), t AS (SELECT *, CASE WHEN ok THEN 1 ELSE 0 END AS score FROM s)
SELECT user_id, CAST(sum(score) AS DOUBLE) AS score, CAST(count(*) AS DOUBLE) AS max_score, bool_and(ok) AS all_correct, bool_or(ok) AND NOT bool_and(ok) AS partly_correct, CASE WHEN bool_and(ok) THEN 'correct' WHEN bool_or(ok) THEN 'partial' ELSE 'incorrect' END AS feedback, string_agg(event_type || '=' || score, ',' ORDER BY event_type) AS details FROM t GROUP BY user_id""")
def q16(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("response_id")).agg((F.max("value") > 100).alias("correct"))
    return scoring.rolled_up(s.select("user_id", "response_id", "correct", F.col("correct").cast("double").alias("score"), F.lit(1.0).alias("max_score")), ["user_id"])


STATE = "e AS (SELECT user_id AS session_id, event_type AS response_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)"


@register("q18_response_state", f"WITH {STATE} SELECT session_id, response_id, value FROM e WHERE n = 1 AND value IS NOT NULL")
def q18(spark: SparkSession, sf: str) -> DataFrame:
    return state(spark, sf)


def state(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("response_id"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), "ts", "event_id")
    return scoring.latest(e, ["session_id", "response_id"], "value", ["ts", "event_id"])


@register("q18_completeness", f"WITH {STATE} SELECT u.user_id AS session_id, count(e.session_id) AS n_answered, count(e.session_id) = (SELECT count(DISTINCT event_type) FROM events) AS complete FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN e ON e.session_id = u.user_id AND n = 1 AND value IS NOT NULL GROUP BY u.user_id")
def q18b(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return scoring.complete(state(spark, sf), e.select(F.col("user_id").alias("session_id")).distinct(), e.select(F.col("event_type").alias("response_id")))
