"""Item normalisation and scalar functions on columns derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import items as I
from lectern.functions import strings as S
from lectern.operators.search import bm25_idf, bm25_saturation, word_tokens
from lectern.plans.registry import register
from lectern.session import table

# Item attributes, derived from documents in SQL that both engines read alike.
ATTRS = {
    "difficulty": "CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '01' WHEN 2 THEN '02 upper mid' WHEN 3 THEN '03 middle' WHEN 4 THEN '04 lower' WHEN 5 THEN 'middle' ELSE '9 odd' END",
    "kind": "CASE doc_id % 5 WHEN 0 THEN '11 choice' WHEN 1 THEN '31 short' WHEN 2 THEN '' WHEN 3 THEN '41 essay' ELSE '21' END",
    "year_text": "CASE WHEN doc_id % 5 = 0 THEN 'n/a' WHEN doc_id % 5 = 1 THEN '' ELSE '' || (1990 + doc_id % 50) END",
    "answer": "CASE doc_id % 8 WHEN 0 THEN '3' WHEN 1 THEN '1,3' WHEN 2 THEN '7' WHEN 3 THEN '' WHEN 4 THEN '2, x' WHEN 5 THEN '1:abc| abd' WHEN 6 THEN '1,9' ELSE 'TRUE' END",
    "kw": "lang || ', ' || source || ';' || doc_id || '_new - ' || (doc_id % 3)",
    "level": "'0' || (doc_id % 4)",
    "grade": "CASE WHEN doc_id % 13 < 10 THEN '0' || (doc_id % 13) ELSE '' || (doc_id % 13) END",
    "image": "CASE doc_id % 4 WHEN 0 THEN 'ID' || chr(92) || 'Pic' || chr(92) || 'a.PNG' WHEN 1 THEN '20240' || (doc_id % 9 + 1) || '15/b.jpeg' WHEN 2 THEN '2023/x/c.txt' ELSE '' END",
}
ATTR_SQL = "a AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in ATTRS.items()) + " FROM documents)"


def attrs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("*", *[f"{v} AS {k}" for k, v in ATTRS.items()])


@register("p1_split_code_label", f"WITH {ATTR_SQL} SELECT doc_id, split_part(difficulty, ' ', 1) AS code, CASE WHEN contains(difficulty, ' ') THEN substr(difficulty, strpos(difficulty, ' ') + 1) ELSE difficulty END AS label FROM a")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    return attrs(spark, sf).select("doc_id", I.code_of(F.col("difficulty")).alias("code"), I.label_of(F.col("difficulty")).alias("label"))


@register("p2_metadata_columns", f"WITH {ATTR_SQL} SELECT doc_id, split_part(kind, ' ', 1) AS kind_code, CASE WHEN contains(kind, ' ') THEN substr(kind, strpos(kind, ' ') + 1) ELSE kind END AS kind, CASE WHEN regexp_full_match(year_text, '[0-9]+') THEN CAST(year_text AS INTEGER) END AS year, lang AS subject, source AS unit FROM a")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    return attrs(spark, sf).select("doc_id", I.code_of(F.col("kind")).alias("kind_code"), I.label_of(F.col("kind")).alias("kind"), I.year_of(F.col("year_text")).alias("year"), F.col("lang").alias("subject"), F.col("source").alias("unit"))


@register("p3_block_rendering", "SELECT doc_id, md5(text || '$' || n_chars || '$' || '[이미지]' || source) AS rendered, CAST(n_chars AS VARCHAR) AS latex, 'a/' || doc_id || '.png' AS image FROM documents")
def p3(spark: SparkSession, sf: str) -> DataFrame:
    block = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("content"))
    blocks = F.array(block("text", F.col("text")), block("latex", F.col("n_chars").cast("string")), block("image", F.concat(F.lit("a\\"), F.col("doc_id"), F.lit(".png"))), block("text", F.col("source")))
    d = table(spark, sf, "documents").select("doc_id", blocks.alias("b"))
    of = lambda kind: F.array_join(F.transform(F.filter("b", lambda x: x["type"] == kind), lambda x: I.slashes(x["content"])), ",")
    return d.select("doc_id", F.md5(I.render(F.col("b")).cast("binary")).alias("rendered"), of("latex").alias("latex"), of("image").alias("image"))


@register("p4_answer_parsing", f"""WITH {ATTR_SQL}, p AS (SELECT doc_id, answer, CASE WHEN regexp_full_match(trim(answer), '[1-5]') THEN CAST(trim(answer) AS INTEGER) END AS single, CASE WHEN contains(answer, ',') THEN list_filter(list_transform(string_split(answer, ','), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]+')) ELSE [] END AS parts FROM a),
q AS (SELECT *, CASE WHEN len(parts) > 0 AND len(list_filter(parts, lambda x: NOT regexp_full_match(x, '[1-5]'))) = 0 THEN array_to_string(parts, ',') ELSE '' END AS many FROM p)
SELECT doc_id, single, many, CASE WHEN single IS NULL AND many = '' THEN trim(answer) ELSE '' END AS answer_text FROM q""")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("answer")
    return attrs(spark, sf).select("doc_id", I.single_answer(c).alias("single"), F.array_join(I.answer_list(c).cast("array<string>"), ",").alias("many"), I.answer_text(c).alias("answer_text"))


@register("p5_answer_forms", f"""WITH {ATTR_SQL} SELECT doc_id, CAST(nullif(regexp_extract(answer, '^([0-9]+):', 1), '') AS INTEGER) AS choice,
array_to_string(list_filter(list_transform(string_split(regexp_replace(answer, '^[0-9]+:', ''), '|'), lambda x: trim(x)), lambda x: x <> ''), '/') AS alternatives,
array_to_string(list_filter(list_transform(string_split_regex(answer, '[,;|]'), lambda x: trim(x)), lambda x: x <> ''), '/') AS blanks, lower(trim(answer)) IN ('true', '참', 'o', '1') AS is_true FROM a""")
def p5(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("answer")
    return attrs(spark, sf).select("doc_id", I.choice_reference(c).alias("choice"), F.array_join(I.alternatives(c), "/").alias("alternatives"), F.array_join(I.blanks(c), "/").alias("blanks"), I.is_true(c).alias("is_true"))


@register("p6_keywords", f"WITH {ATTR_SQL} SELECT doc_id, array_to_string(list_filter(string_split_regex(kw, '[,;_\\-\\s]+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+')), ' ') AS keywords FROM a")
def p6(spark: SparkSession, sf: str) -> DataFrame:
    return attrs(spark, sf).select("doc_id", F.array_join(I.keywords(F.col("kw")), " ").alias("keywords"))


@register("p7_category", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'image' WHEN length(text) - length(replace(text, '$', '')) > 0 THEN 'latex' ELSE 'text_only' END AS category FROM documents")
def p7(spark: SparkSession, sf: str) -> DataFrame:
    dollars = F.length("text") - F.length(F.replace("text", F.lit("$"), F.lit("")))
    return table(spark, sf, "documents").select("doc_id", I.category(F.col("doc_id") % 3 == 0, dollars).alias("category"))


# Raw values and what they are normalised to, by the place in the list.
RAW = {
    "subject": [("", "수학"), ("05", "과학"), ("영어", "영어"), ("06 역사", "역사"), ("심화 과학 반", "과학"), ("zz", "수학"), ("x 도덕", "도덕")],
    "grade": [("", ""), ("08", "중2"), ("고1", "고1"), ("04 x", "초4"), ("2", "초2"), ("9", ""), ("중4", "")],
    "difficulty": [("", "medium"), ("01", "easy"), ("상", "hard"), ("03 하", "hard"), ("x 하", "easy"), ("HIGH", "hard"), ("odd", "medium")],
    "question_type": [("", ""), ("11", "선택형"), ("서술형", "서술형"), ("11 선택형", ""), ("99", "")],
}
RAW_SQL = ", ".join(f"CASE doc_id % {len(v)} " + " ".join(f"WHEN {i} THEN '{to}'" for i, (_, to) in enumerate(v)) + f" END AS {k}" for k, v in RAW.items())


@register("p8_code_normaliser", f"""WITH n AS (SELECT doc_id, {RAW_SQL} FROM documents) SELECT doc_id, subject, CASE subject WHEN '수학' THEN '03' WHEN '과학' THEN '05' WHEN '영어' THEN '02' WHEN '역사' THEN '06' ELSE '07' END AS subject_code, grade,
CASE grade WHEN '중2' THEN '08' WHEN '고1' THEN '10' WHEN '초4' THEN '04' WHEN '초2' THEN '02' ELSE '' END AS grade_code, CASE left(grade, 1) WHEN '초' THEN '초등학교' WHEN '중' THEN '중학교' WHEN '고' THEN '고등학교' ELSE '' END AS school_level,
CASE left(grade, 1) WHEN '초' THEN '01' WHEN '중' THEN '02' WHEN '고' THEN '03' ELSE '' END AS school_level_code, difficulty, question_type FROM n""")
def p8(spark: SparkSession, sf: str) -> DataFrame:
    raw = [F.element_at(F.array(*[F.lit(x) for x, _ in v]), (F.col("doc_id") % len(v) + 1).cast("int")) for v in RAW.values()]
    return table(spark, sf, "documents").select("doc_id", I.normal_metadata(*raw).alias("m")).select("doc_id", "m.*")


@register("p9_grade_names", f"""WITH {ATTR_SQL}, n AS (SELECT doc_id, level, CAST(grade AS INTEGER) AS n FROM a) SELECT doc_id, CASE
WHEN level = '01' THEN CASE WHEN n BETWEEN 1 AND 6 THEN '초' || n ELSE '' END WHEN level = '02' THEN CASE WHEN n BETWEEN 7 AND 9 THEN '중' || (n - 6) WHEN n BETWEEN 1 AND 3 THEN '중' || n ELSE '' END
WHEN level = '03' THEN CASE WHEN n BETWEEN 10 AND 12 THEN '고' || (n - 9) WHEN n BETWEEN 1 AND 3 THEN '고' || n ELSE '' END
WHEN n BETWEEN 1 AND 6 THEN '초' || n WHEN n BETWEEN 7 AND 9 THEN '중' || (n - 6) WHEN n BETWEEN 10 AND 12 THEN '고' || (n - 9) ELSE '' END AS grade_name FROM n""")
def p9(spark: SparkSession, sf: str) -> DataFrame:
    return attrs(spark, sf).select("doc_id", I.grade_name(F.col("level"), F.col("grade")).alias("grade_name"))


@register("p10_metadata_override", f"WITH {ATTR_SQL} SELECT a.doc_id, coalesce(nullif(CASE WHEN l.quality = 0 THEN 'low' WHEN l.toxic = 1 THEN '' END, ''), a.difficulty) AS difficulty FROM a LEFT JOIN labels l ON a.doc_id = l.doc_id")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    over = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "").alias("o"))
    return attrs(spark, sf).join(over, "doc_id", "left").select("doc_id", I.overridden(F.col("o"), F.col("difficulty")).alias("difficulty"))


@register("p13_image_paths", f"""WITH {ATTR_SQL}, s AS (SELECT doc_id, replace(image, chr(92), '/') AS path FROM a) SELECT doc_id, path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension,
CASE WHEN regexp_matches(path, '(^|/)[0-9]{{8}}/') THEN 'date' WHEN regexp_matches(path, '(^|/)[0-9]{{4}}/') THEN 'year' ELSE 'other' END AS layout FROM s""")
def p13(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("image")
    return attrs(spark, sf).select("doc_id", I.slashes(c).alias("path"), I.extension(c).alias("extension"), I.folder_layout(c).alias("layout"))


@register("p14_embedding_text", "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '문제: ' || lang || chr(10) || '선택지:' || chr(10) || '1. ' || source || chr(10) || '2. ' || n_chars ELSE '문제: ' || lang END AS labelled, lang || ' 1. ' || source || ' 2. ' || n_chars AS plain FROM documents")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    two = F.array(F.col("source"), F.col("n_chars").cast("string"))
    some = F.when(F.col("doc_id") % 3 > 0, two).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", I.embedding_text(F.col("lang"), some).alias("labelled"), I.embedding_text(F.col("lang"), two, labelled=False).alias("plain"))


@register("p15_context_assembly", "SELECT conv_id, string_agg('[' || turn || '] score ' || printf('%.3f', 1.0 / (turn + 2)) || ' (' || coalesce(role, 'N/A') || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.struct(F.col("turn").alias("rank"), F.col("turn").alias("item_id"), (1.0 / (F.col("turn") + 2)).alias("score"), F.col("role").alias("category"), F.col("text"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(hit)).alias("hits")).select("conv_id", I.context(F.col("hits")).alias("context"))


@register("p16_prompt_dataset", "SELECT doc_id, 'Write an item like: ' || text || chr(10) || 'Subject: ' || coalesce(nullif(lang, ''), 'any') || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'Change the numbers.' WHEN 1 THEN 'Change the setting.' ELSE 'Keep the idea.' END || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'Use the image.' ELSE '' END AS prompt FROM documents")
def p16(spark: SparkSession, sf: str) -> DataFrame:
    clause = F.create_map(F.lit(0), F.lit("Change the numbers."), F.lit(1), F.lit("Change the setting."), F.lit(2), F.lit("Keep the idea."))
    prompt = F.concat(F.lit("Write an item like: "), F.col("text"), F.lit("\nSubject: "), F.coalesce(F.nullif("lang", F.lit("")), F.lit("any")), F.lit("\n"), F.try_element_at(clause, (F.col("doc_id") % 3).cast("int")), F.when(F.col("doc_id") % 4 == 0, "\nUse the image.").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", prompt.alias("prompt"))


@register("p17_response_declaration", f"""WITH {ATTR_SQL}, k AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN '해설참조' WHEN lang = 'de' AND doc_id % 2 = 0 THEN ' 풀이참조 ' ELSE answer END AS answer, split_part(kind, ' ', 1) AS code, doc_id % 3 AS daps FROM a),
c AS (SELECT *, trim(answer) IN ('해설참조', '풀이참조') AS points, CASE WHEN code IN ('11', '21') THEN 'choice' WHEN code IN ('31', '34') THEN 'text_entry' ELSE 'extended_text' END AS interaction FROM k)
SELECT doc_id, interaction, CASE WHEN daps > 1 THEN 'multiple' ELSE 'single' END AS cardinality, CASE WHEN interaction = 'choice' THEN 'identifier' ELSE 'string' END AS base_type,
CASE WHEN points OR interaction = 'extended_text' THEN '' WHEN interaction = 'choice' THEN array_to_string(list_transform(list_filter(list_transform(string_split(answer, ','), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: 'choice_' || x), ',') ELSE trim(answer) END AS correct,
interaction <> 'extended_text' AND NOT points AND trim(answer) <> '' AS scored FROM c""")
def p17(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.when(F.col("lang") == "fr", "해설참조").when((F.col("lang") == "de") & (F.col("doc_id") % 2 == 0), " 풀이참조 ").otherwise(F.col("answer"))
    a = attrs(spark, sf).withColumn("answer", answer)
    return a.select("doc_id", I.declaration(I.code_of(F.col("kind")), F.col("answer"), F.col("doc_id") % 3).alias("d")).select("doc_id", "d.*")


@register("p18_generated_items", "SELECT 'AI_' || upper(substr(sha256(CAST(o.o_orderkey AS VARCHAR)), 1, 16)) AS id, c.c_custkey AS source_item_id, c.c_mktsegment AS subject, c.c_nationkey AS grade, true AS is_ai_generated FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def p18(spark: SparkSession, sf: str) -> DataFrame:
    made, source = table(spark, sf, "orders"), table(spark, sf, "customer")
    name = F.concat(F.lit("AI_"), F.upper(F.substring(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256), 1, 16)))
    return made.join(source, made["o_custkey"] == source["c_custkey"]).select(name.alias("id"), F.col("c_custkey").alias("source_item_id"), F.col("c_mktsegment").alias("subject"), F.col("c_nationkey").alias("grade"), F.lit(True).alias("is_ai_generated"))


@register("p19_boxes_to_pixels", "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity / 1000 * 800) AS INTEGER) AS x0, CAST(trunc(l_linenumber * 10 / 1000 * 600) AS INTEGER) AS y0, CAST(trunc((l_quantity + 500) / 1000 * 800) AS INTEGER) AS x1, CAST(trunc((l_linenumber * 10 + 300) / 1000 * 600) AS INTEGER) AS y1 FROM lineitem")
def p19(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    box = F.array((F.col("l_linenumber") * 10).cast("double"), F.col("l_quantity"), (F.col("l_linenumber") * 10 + 300).cast("double"), F.col("l_quantity") + 500)
    return rows.select("l_orderkey", "l_linenumber", I.pixels(box, F.lit(800), F.lit(600)).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@register("x1_collapse", "SELECT doc_id, md5(trim(regexp_replace(replace(text, '.', ' [이미지] '), '\\s+', ' ', 'g'))) AS h FROM documents")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(S.spaced_images(F.replace("text", F.lit("."), F.lit("[이미지]"))).cast("binary")).alias("h"))


FORMULA = "'{{ ' || p_size || ' 2 5 . 5 x + A B C  =  ' || chr(92) || 'cfrac {{ 1 }} {{ ' || p_partkey || ' }} , ' || chr(92) || 'angle  D E ~ c m ( ' || p_size || ' ' || chr(92) || 'degree ) ^ {{ 2 }} }}'".replace("{{", "{").replace("}}", "}")


# What the formula above is cleaned to, worked out by hand from the rules.
CLEANED = "p_size || '25.5x + ABC = ' || chr(92) || 'cfrac{1}{' || p_partkey || '} , ∠DE ~cm (' || p_size || '°) ^{2}'"


@register("x2_latex_cleaner", f"SELECT p_partkey, {CLEANED} AS cleaned FROM part")
def x2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey", f"{FORMULA} AS f").select("p_partkey", S.clean_latex(F.col("f")).alias("cleaned"))


@register("x3_latex_spans", f"SELECT p_partkey, p_name || ' $' || {CLEANED} || '$ end $1 2' AS cleaned FROM part")
def x3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey", f"p_name || ' $' || {FORMULA} || '$ end $1 2' AS f").select("p_partkey", S.clean_spans(F.col("f")).alias("cleaned"))


@register("x4_viewer_latex", "SELECT p_partkey, '{' || p_size || ' 2 5 . 5 x + A B C = ' || chr(92) || 'cfrac {1} {' || p_partkey || '} , ' || chr(92) || 'angle D E ~ c m ( ' || p_size || ' ' || chr(92) || 'degree ) ^ {2}} ' || chr(92) || 'text{넓이}' AS shown FROM part")
def x4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey", f"'{{ ' || {FORMULA} || ' 넓이 }}' AS f").select("p_partkey", S.viewer_latex(F.col("f")).alias("shown"))


@register("x5_brace_balance", "SELECT page_id, length(html) - length(replace(html, '{', '')) = length(html) - length(replace(html, '}', '')) AS balanced, length(html) - length(replace(html, '{', '')) = length(html) - length(replace(html, '}', '')) AND list_reduce(list_prepend([0, 0], list_transform(regexp_extract_all(html, '[{}]'), lambda x: [CASE WHEN x = '{' THEN 1 ELSE -1 END, 0])), lambda a, b: [a[1] + b[1], least(a[2], a[1] + b[1])])[2] >= 0 AS prefix_balanced FROM pages")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", S.balanced(F.col("html")).alias("balanced"), S.prefix_balanced(F.col("html")).alias("prefix_balanced"))


@register("x6_retrieval_text", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\$[^$]*\\$', ' [수식] ', 'g'), '[^\\p{L}\\p{N}_\\s\\[\\]]', ' ', 'g'), '\\s+', ' ', 'g'))) AS h FROM documents")
def x6(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(S.retrieval_text(F.col("text")).cast("binary")).alias("h"))


@register("x7_tokens", "SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: length(x) > 1) AS t FROM documents)")
def x7(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", word_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("h"))


@register("x8_markup", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')) AS unescaped, '<span class=\"math\">' || page_id || '</span>' AS math FROM pages")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.md5(S.xml_escape(h).cast("binary")).alias("escaped"), F.md5(S.xml_unescape(h).cast("binary")).alias("unescaped"), S.math_spans(F.concat(F.lit("$"), "page_id", F.lit("$"))).alias("math"))


STANDARD = "'[' || (doc_id % 9 + 1) || '수0' || (doc_id % 7) || '-1' || (doc_id % 5) || '] ' || lang || ' [9국02-03] ' || source"


@register("x9_standard_codes", "SELECT doc_id, (doc_id % 9 + 1) || '수0' || (doc_id % 7) || '-1' || (doc_id % 5) AS code, CAST(doc_id % 9 + 1 AS INTEGER) AS grade, '수' AS subject, '0' || (doc_id % 7) AS unit, '1' || (doc_id % 5) AS number, lang AS content FROM documents UNION ALL SELECT doc_id, '9국02-03', 9, '국', '02', '03', source FROM documents")
def x9(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", f"{STANDARD} AS s").select("doc_id", F.inline(S.standards(F.col("s"))))


@register("x10_compare_key", "SELECT page_id, lower(trim(regexp_replace('  ' || url || '  A ' || chr(9) || ' b ', '\\s+', ' ', 'g'))) AS key FROM pages")
def x10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", S.compare_key(F.concat(F.lit("  "), "url", F.lit("  A \t b "))).alias("key"))


@register("x11_json_recovery", "SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN '[' || event_id || ']' ELSE props END AS json FROM events")
def x11(spark: SparkSession, sf: str) -> DataFrame:
    forms = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'So:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'It is ' || props || ' indeed' WHEN 3 THEN 'none {' ELSE 'list [' || event_id || '] end' END AS answer"
    return table(spark, sf, "events").selectExpr("event_id", forms).select("event_id", S.recovered_json(F.col("answer")).alias("json"))


@register("x12_tolerant_json", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|' || user_id WHEN 1 THEN event_type ELSE '' END AS joined, CAST(CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS n FROM events")
def x12(spark: SparkSession, sf: str) -> DataFrame:
    forms = """CASE event_id % 3 WHEN 0 THEN '["' || event_type || '", "' || user_id || '"]' WHEN 1 THEN event_type ELSE '' END AS c"""
    return table(spark, sf, "events").selectExpr("event_id", forms).select("event_id", S.json_strings(F.col("c")).alias("a")).select("event_id", F.array_join("a", "|").alias("joined"), F.size("a").alias("n"))


@register("x16_numbers_expressions", """SELECT event_id, CAST(2 AS INTEGER) AS n, round(CASE event_id % 4 WHEN 0 THEN abs(value) + user_id WHEN 1 THEN abs(value) - user_id WHEN 2 THEN abs(value) * user_id ELSE CASE WHEN user_id = 0 THEN NULL ELSE abs(value) / user_id END END, 6) AS result,
CASE WHEN event_id % 4 = 3 AND user_id = 0 THEN NULL ELSE abs(value * 1.005 - value) <= greatest(abs(value) * 0.01, 0.001) END AS close FROM events""")
def x16(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    op = F.element_at(F.array(*[F.lit(x) for x in (" + ", " - ", " × ", " ÷ ")]), (F.col("event_id") % 4 + 1).cast("int"))
    expr = e.select("event_id", "user_id", "value", F.concat(F.col("value").cast("decimal(20,2)").cast("string"), op, F.col("user_id").cast("string")).alias("x"))
    r = S.evaluated(F.col("x"))
    return expr.select("event_id", F.size(S.numbers(F.col("x"))).alias("n"), F.round(r, 6).alias("result"), F.when(r.isNotNull(), S.close(F.col("value") * 1.005, F.col("value"))).alias("close"))


@register("x17_ratio_guard", "SELECT s_suppkey, round(CASE WHEN s_nationkey > 0 THEN s_acctbal / s_nationkey * 100 ELSE 0 END, 6) AS ratio FROM supplier")
def x17(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", F.round(S.ratio(F.col("s_acctbal"), F.col("s_nationkey")), 6).alias("ratio"))


@register("x18_path_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, year(o_orderdate) BETWEEN 2000 AND 2030 AS in_range FROM orders")
def x18(spark: SparkSession, sf: str) -> DataFrame:
    form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    d = table(spark, sf, "orders").select("o_orderkey", S.path_date(F.concat(F.lit("data/"), form, F.lit("/x.iml"))).alias("day"))
    return d.select("o_orderkey", F.col("day").cast("string").alias("day"), F.year("day").between(2000, 2030).alias("in_range"))


@register("x15_bm25_weights", "SELECT p_partkey, round(ln((100000 - p_partkey + 0.5) / (p_partkey + 0.5) + 1), 6) AS idf, round(p_size * 2.5 / (p_size + 1.5 * (0.25 + 0.75 * p_retailprice / 1000)), 6) AS saturation FROM part")
def x15(spark: SparkSession, sf: str) -> DataFrame:
    idf = bm25_idf(F.lit(100000), F.col("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", F.round(idf, 6).alias("idf"), F.round(bm25_saturation(F.col("p_size"), F.col("p_retailprice"), F.lit(1000)), 6).alias("saturation"))


@register("x19_entities", "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS years, year(o_orderdate) || '' || month(o_orderdate) || day(o_orderdate) AS dates, '이순신,군민' AS persons, '임진전쟁' AS events, '서울시,강원도' AS places FROM orders")
def x19(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.date_format("o_orderdate", "yyyy년 M월 d일"), F.lit(" 이순신은 서울시 앞 임진전쟁 때 "), F.date_format("o_orderdate", "yyyy년"), F.lit(" 강원도 군민에게 "), F.col("o_orderkey").cast("string"))
    d = table(spark, sf, "orders").select("o_orderkey", t.alias("t"))
    return d.select("o_orderkey", *[F.array_join(S.entities(F.col("t"), k), ",").alias(f"{k}s") for k in S.ENTITIES])


@register("x20_attribute_fallback", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source ELSE '11' END AS kind FROM documents")
def x20(spark: SparkSession, sf: str) -> DataFrame:
    m = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("qt"), "lang", F.lit("vt"), F.lit("z"))).when(F.col("doc_id") % 3 == 1, F.create_map(F.lit("qt"), F.lit(""), F.lit("vt"), "source")).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    return table(spark, sf, "documents").select("doc_id", S.first_attribute(m, ["qt", "vt"], "11").alias("kind"))
