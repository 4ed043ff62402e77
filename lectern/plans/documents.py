"""Item documents: XML items made of the driver's documents, parsed, checked and summed up; standards files.

Every sixth document is whole; the others lack their id, type, question or item element, or are malformed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import strings as S
from lectern.operators import quality as Q
from lectern.plans.registry import register
from lectern.session import scratch, table
from lectern.sources import items

# What both engines know of a document: k is its variant, t its text without control characters.
D = "d AS (SELECT doc_id, doc_id % 6 AS k, regexp_replace(coalesce(text, ''), '[\\x00-\\x1F]', ' ', 'g') AS t, lang, source FROM documents)"


def raw_items(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): one XML item a document."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 6).alias("k"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x1F]", " ").alias("t"), "lang", "source")
    k, text = F.col("k"), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = F.col("doc_id").cast("string")
    head = text(
        F.when(k == 1, "").otherwise(text(' id="D', number, '"')), F.when(k == 2, "").otherwise(' qt="11 선택형"'), ' df="03 ', F.col("lang"), '" cls1="A13 과정" cls4="03 수학" cls9="x ', F.col("source"),
        '" kw="a, b" dyear="', F.when(F.col("doc_id") % 4 == 0, "n/a").otherwise((2000 + F.col("doc_id") % 30).cast("string")), '"',
    )
    stem = text("<물음><단락><문자열>", S.xml_escape(F.col("t")), "<수식> { 1 0 } </수식> tail</문자열><문자열> </문자열><그림>ID\\Pic\\", number, ".png</그림></단락></물음>")
    options = "<답항><단락><문자열>one</문자열></단락></답항><답항><단락><문자열>two</문자열></단락></답항>"
    question = F.when(k == 3, "").otherwise(text("<문제>", stem, options, "</문제>"))
    rest = "<정답><단락><문자열> 2 </문자열></단락></정답><해설><단락><문자열>  </문자열></단락></해설>"
    whole = text("<문항종류><단위문항><문항", head, ">", question, rest, "</문항></단위문항></문항종류>")
    body = F.when(k == 4, "<문항종류><단위문항/></문항종류>").when(k == 5, text("<broken ", number)).otherwise(whole)
    return d.select(text("d", number).alias("path"), F.encode(body, "UTF-8").alias("content"))


@register(
    "s2_item_documents",
    f"""WITH {D}, i AS (SELECT *, k IN (0, 1, 2) AS q, k < 4 AS item FROM d)
SELECT 'd' || doc_id AS path, CASE WHEN k IN (0, 2, 3) THEN 'D' || doc_id ELSE '' END AS id, CASE k WHEN 1 THEN 'missing id' WHEN 2 THEN 'missing qt' WHEN 3 THEN 'missing question' WHEN 4 THEN 'no item element' WHEN 5 THEN 'malformed' ELSE '' END AS errors,
CASE WHEN q THEN md5(t || ' tail') ELSE md5('') END AS question, CASE WHEN q THEN '{{ 1 0 }}' ELSE '' END AS latex, CASE WHEN q THEN 'ID/Pic/' || doc_id || '.png' ELSE '' END AS images, CASE WHEN q THEN 'one|two' ELSE '' END AS choices,
CASE WHEN item THEN '2' ELSE '' END AS answer, CAST(0 AS INTEGER) AS n_explanation FROM i""",
)
def s2(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda kind: F.array_join(F.transform(F.filter("question", lambda b: b["type"] == kind), lambda b: b["content"]), "|")
    return items.parsed(raw_items(spark, sf)).select(
        F.col("source_file").alias("path"), "id", F.regexp_replace(F.array_join("parse_errors", ";"), "(?s)^malformed.*", "malformed").alias("errors"), F.md5(of("text").cast("binary")).alias("question"), of("latex").alias("latex"),
        F.array_join("images", "|").alias("images"), F.array_join(F.transform("choices", lambda c: F.get(c, F.lit(0))["content"]), "|").alias("choices"), F.col("answer_raw").alias("answer"), F.size("explanation").alias("n_explanation"),
    )


@register(
    "p2_item_metadata",
    f"""WITH {D}, i AS (SELECT *, k < 4 AS item FROM d)
SELECT 'd' || doc_id AS path, CASE WHEN item THEN '03' ELSE '' END AS difficulty_code, CASE WHEN item THEN lang ELSE '' END AS difficulty, CASE WHEN item AND k <> 2 THEN '11' ELSE '' END AS question_type_code, CASE WHEN item AND k <> 2 THEN '선택형' ELSE '' END AS question_type,
CASE WHEN item THEN '과정' ELSE '' END AS curriculum, '' AS school_level, '' AS grade, CASE WHEN item THEN '수학' ELSE '' END AS subject, '' AS subject_detail, '' AS semester, '' AS unit_large, '' AS unit_medium, CASE WHEN item THEN source ELSE '' END AS unit_small,
CASE WHEN item THEN 'a, b' ELSE '' END AS keywords, '' AS source, '' AS exam_name, CASE WHEN item AND doc_id % 4 <> 0 THEN CAST(2000 + doc_id % 30 AS INTEGER) END AS year FROM i""",
)
def p2_items(spark: SparkSession, sf: str) -> DataFrame:
    return items.parsed(raw_items(spark, sf)).select(F.col("source_file").alias("path"), "metadata.*")


@register("q19_item_documents", f"WITH {D} SELECT 'd' || doc_id AS path, k = 0 AS valid, CASE k WHEN 1 THEN 'missing_id' WHEN 2 THEN 'missing_qt' WHEN 3 THEN 'missing_question' WHEN 4 THEN 'no_item_element' WHEN 5 THEN 'malformed' ELSE '' END AS errors FROM d")
def q19_items(spark: SparkSession, sf: str) -> DataFrame:
    errors = Q.document_errors(F.col("parse_errors"))
    return items.parsed(raw_items(spark, sf)).select(F.col("source_file").alias("path"), (F.size(errors) == 0).alias("valid"), F.array_join(errors, ";").alias("errors"))


@register(
    "s3_tag_schema",
    """WITH v AS (SELECT * FROM (VALUES ('문항종류', 'ROOT', '단위문항'), ('단위문항', '문항종류', '문항'), ('문항', '단위문항', '문제,정답,해설'), ('문제', '문항', '답항,물음'), ('물음', '문제', '단락'), ('답항', '문제', '단락'), ('단락', '답항,물음,정답,해설', '그림,문자열'),
('문자열', '단락', '수식'), ('수식', '문자열', ''), ('그림', '단락', ''), ('정답', '문항', '단락'), ('해설', '문항', '단락')) x(tag, parents, children)) SELECT * FROM v WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id % 6 < 3)""",
)
def s3_tags(spark: SparkSession, sf: str) -> DataFrame:
    return items.tag_schema(items.edges(raw_items(spark, sf))).select("tag", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


@register(
    "s3_attribute_schema",
    f"""WITH {D}, i AS (SELECT * FROM d WHERE k < 4), a AS (SELECT 'id' AS attribute, 'D' || doc_id AS value FROM i WHERE k <> 1 UNION SELECT 'qt', '11 선택형' FROM i WHERE k <> 2 UNION SELECT 'df', '03 ' || lang FROM i UNION SELECT 'cls1', 'A13 과정' FROM i UNION SELECT 'cls4', '03 수학' FROM i
UNION SELECT 'cls9', 'x ' || source FROM i UNION SELECT 'kw', 'a, b' FROM i UNION SELECT 'dyear', CASE WHEN doc_id % 4 = 0 THEN 'n/a' ELSE '' || (2000 + doc_id % 30) END FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY value) AS n FROM a)
SELECT '문항' AS tag, attribute, value FROM r WHERE n <= 20""",
)
def s3_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return items.attribute_samples(items.edges(raw_items(spark, sf)))


@register("s14_standards_file", "SELECT '9수' || n_nationkey AS code, n_name AS description, 'r' || n_regionkey AS domain FROM nation")
def s14(spark: SparkSession, sf: str) -> DataFrame:
    """A standards file with blanks around its values, written and read back."""
    path = scratch(spark, "standards")
    padded = lambda c: F.concat(F.lit("  "), c, F.lit(" "))
    rows = table(spark, sf, "nation").select(padded(F.concat(F.lit("9수"), "n_nationkey")).alias("code"), padded(F.col("n_name")).alias("description"), padded(F.concat(F.lit("r"), "n_regionkey")).alias("domain"))
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return items.standards(spark, path)
