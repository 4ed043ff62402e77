"""Search, fusion, ground truth and evaluation queries on the driver's tables.

Vectors: the rows of ``embeddings`` whose id is divisible by 20 are the queries against all rows, and items of the same label
are relevant. Texts: ``benchmark`` passages search ``documents``. Hybrid search runs over documents that have a vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine, dot, fused, norm
from lectern.operators import groundtruth as gt
from lectern.operators import metrics, search
from lectern.plans.registry import register
from lectern.session import cut, table

KNN = """
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e, label AS query_label FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, q.query_label, c.vec_id AS item_id, c.label, round(list_cosine_similarity(q.e, CAST(c.embedding AS DOUBLE[])), 6) AS score
      FROM q JOIN embeddings c ON c.vec_id <> q.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)"""
TRUTH = "t AS (SELECT q.query_id, c.vec_id AS item_id, 1 + c.vec_id % 3 AS relevance FROM q JOIN embeddings c ON c.label = q.query_label AND c.vec_id <> q.query_id)"
TOKENS = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: length(x) > 1)"
BM25 = f"""
dt AS (SELECT item_id, {TOKENS.format("text")} AS tk FROM corpus),
tot AS (SELECT count(*) AS n_docs, avg(len(tk)) AS mean_length FROM dt),
qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format("text")}) AS token FROM asked) GROUP BY ALL),
p AS (SELECT item_id, length, token, count(*) AS tf FROM (SELECT item_id, len(tk) AS length, unnest(tk) AS token FROM dt) GROUP BY ALL),
d AS (SELECT token, count(*) AS df FROM p GROUP BY token),
bm AS (SELECT qt.query_id, p.item_id, round(sum(times * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean_length))), 6) AS score
       FROM qt JOIN p ON qt.token = p.token JOIN d ON p.token = d.token CROSS JOIN tot WHERE qt.query_id <> p.item_id GROUP BY ALL)"""
MEANS = ", ".join(f"CAST(round(avg({c}), 6) AS DOUBLE) AS {c}" for k in metrics.CUTS for c in (f"recall_{k}", f"hit_{k}", f"ndcg_{k}")) + ", CAST(round(avg(rr), 6) AS DOUBLE) AS rr, CAST(round(avg(ap), 6) AS DOUBLE) AS ap"


def metric_sql(ranked: str = "r", keys: str = "query_id") -> str:
    """Per-query metrics of ``ranked`` (rank up to 20 kept beforehand) against t, as CTEs ending in m."""
    extra = keys.removesuffix("query_id").rstrip(", ")
    every = f"(SELECT DISTINCT {extra} FROM {ranked}) x CROSS JOIN wanted" if extra else "wanted"
    same = " AND ".join(f"e.{k.strip()} = found.{k.strip()}" for k in keys.split(","))
    cuts = metrics.CUTS
    return (
        "place AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, item_id) AS place FROM t),\n"
        "wanted AS (SELECT query_id, count(*) AS n_rel, " + ", ".join(f"sum(relevance / log2(place + 1)) FILTER (place <= {k}) AS ideal_{k}" for k in cuts) + " FROM place GROUP BY query_id),\n"
        f"hits AS (SELECT {ranked}.*, t.relevance, row_number() OVER (PARTITION BY {', '.join(ranked + '.' + k.strip() for k in keys.split(','))} ORDER BY {ranked}.rank) AS seen FROM {ranked} JOIN t ON {ranked}.query_id = t.query_id AND {ranked}.item_id = t.item_id),\n"
        f"found AS (SELECT {keys}, min(rank) AS first, sum(seen / rank) AS ps, " + ", ".join(f"count(*) FILTER (rank <= {k}) AS hits_{k}, sum(relevance / log2(rank + 1)) FILTER (rank <= {k}) AS gain_{k}" for k in cuts) + f" FROM hits GROUP BY {keys}),\n"
        f"e AS (SELECT * FROM {every}),\n"
        f"m AS (SELECT {', '.join('e.' + k.strip() for k in keys.split(','))}, " + ", ".join(f"round(coalesce(hits_{k} / n_rel, 0.0), 6) AS recall_{k}, CASE WHEN coalesce(hits_{k}, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_{k}, round(coalesce(gain_{k}, 0.0) / ideal_{k}, 6) AS ndcg_{k}" for k in cuts) + f", round(coalesce(1.0 / first, 0.0), 6)::DOUBLE AS rr, round(coalesce(ps / n_rel, 0.0), 6) AS ap FROM e LEFT JOIN found ON {same})"
    )


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label")), e.select(F.col("vec_id").alias("item_id"), "embedding", "label")


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the query's label, graded 1 to 3."""
    q, c = vectors(spark, sf)
    return q.join(c, (q["query_label"] == c["label"]) & (q["query_id"] != c["item_id"])).select("query_id", "item_id", (1 + F.col("item_id") % 3).cast("int").alias("relevance"))


def same_label(spark: SparkSession, sf: str) -> metrics.Grouped:
    """:func:`truth` by its groups, without the pairs."""
    q, c = vectors(spark, sf)
    return metrics.same_group(q.select("query_id", F.col("query_label").alias("group")), c.select(F.col("label").alias("group"), "item_id", (1 + F.col("item_id") % 3).cast("int").alias("relevance")))


def passages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    return b.select((-1 - F.col("item_id")).alias("query_id"), "text"), d.select(F.col("doc_id").alias("item_id"), "text")


def hybrid_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents with a vector: (item_id, text, embedding), and every 20th of them as queries. They are written once, as all texts are shuffled to find them."""
    both = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    both = cut(both, "both")
    return both.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id"), both


@register("w1_knn_topk", f"WITH {KNN} SELECT query_id, item_id, score, rank, label FROM r WHERE rank <= 10")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    q, c = vectors(spark, sf)
    return search.knn(q, c, 10).join(c.select("item_id", "label"), "item_id").select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"), "label")


@register("w2_topk_threshold", f"WITH {KNN} SELECT item_id, score FROM s WHERE query_id = 0 AND score >= 0.1 ORDER BY score DESC, item_id LIMIT 15")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    q, c = vectors(spark, sf)
    return search.knn(q.where("query_id = 0"), c, 15, threshold=0.1).select("item_id", "score")


@register("j8_cosine_matrix", f"WITH {KNN} SELECT query_id, item_id, score FROM s")
def j8(spark: SparkSession, sf: str) -> DataFrame:
    return search.cosine_pairs(*vectors(spark, sf))


@register("w3_rank_of_relevant", f"WITH {KNN}, {TRUTH} SELECT t.query_id, t.item_id, CAST(CASE WHEN r.rank <= 50 THEN r.rank ELSE 999 END AS BIGINT) AS rank FROM t LEFT JOIN r ON t.query_id = r.query_id AND t.item_id = r.item_id")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return gt.ranks_of(search.knn(*vectors(spark, sf), 50), truth(spark, sf))


@register(
    "w4_rank_buckets",
    f"""WITH {KNN}, {TRUTH}, k AS (SELECT t.query_id, t.item_id, CASE WHEN r.rank <= 50 THEN r.rank ELSE 999 END AS rank FROM t LEFT JOIN r ON t.query_id = r.query_id AND t.item_id = r.item_id)
SELECT CASE WHEN rank <= 5 THEN '1-5' WHEN rank <= 10 THEN '6-10' WHEN rank <= 20 THEN '11-20' ELSE '21+' END AS bucket, count(*) AS n, count(*) FILTER (rank = 1) AS n_first FROM k GROUP BY 1""",
)
def w4(spark: SparkSession, sf: str) -> DataFrame:
    return gt.rank_buckets(gt.ranks_of(search.knn(*vectors(spark, sf), 50), truth(spark, sf)))


@register(
    "w5_first_rank_regressions",
    f"""WITH {KNN}, {TRUTH}, k AS (SELECT t.query_id, t.relevance, CASE WHEN r.rank <= 50 THEN r.rank ELSE 999 END AS rank FROM t LEFT JOIN r ON t.query_id = r.query_id AND t.item_id = r.item_id),
a AS (SELECT query_id, min(rank) AS first_all FROM k GROUP BY 1), b AS (SELECT query_id, min(rank) AS first_best FROM k WHERE relevance = 3 GROUP BY 1)
SELECT a.query_id, first_all, first_best, first_best - first_all AS diff FROM a JOIN b ON a.query_id = b.query_id ORDER BY diff DESC, query_id LIMIT 5""",
)
def w5(spark: SparkSession, sf: str) -> DataFrame:
    t = truth(spark, sf)
    ranks = gt.ranks_of(search.knn(*vectors(spark, sf), 50), t).join(t, ["query_id", "item_id"])
    return gt.first_rank_regressions(ranks, ranks.where("relevance = 3"), 5)


@register("w6_graded_relevance", f"WITH {KNN} SELECT query_id, item_id, CASE WHEN rank <= 2 THEN 3 WHEN rank <= 4 THEN 2 ELSE 1 END AS relevance FROM r WHERE rank <= 5")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    return gt.graded(search.knn(*vectors(spark, sf), 5))


@register("w9_minmax", f"WITH {KNN} SELECT query_id, item_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS scaled FROM r WHERE rank <= 20 WINDOW w AS (PARTITION BY query_id)")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    return search.minmax(search.knn(*vectors(spark, sf), 20)).select("query_id", "item_id", F.round("scaled", 6).alias("scaled"))


@register("w11_verification_sample", f"WITH {KNN}, {TRUTH} SELECT query_id, string_agg(item_id || ':' || CASE WHEN label = query_label THEN 'y' ELSE 'n' END, ' ' ORDER BY rank) AS hits FROM r WHERE rank <= 10 AND query_id IN (SELECT DISTINCT query_id FROM t ORDER BY query_id LIMIT 50) GROUP BY query_id")
def w11(spark: SparkSession, sf: str, n: int = 50) -> DataFrame:
    """Hits of the first ``n`` queries of the ground truth, by id."""
    (q, c), t = vectors(spark, sf), truth(spark, sf)
    sample = t.select("query_id").distinct().orderBy("query_id").limit(n)
    return gt.verification(search.knn(q.join(sample, "query_id", "left_semi"), c, 10), t)


@register("j9_candidate_pairs", f"WITH {KNN} SELECT a, b, max(score) AS score FROM (SELECT least(query_id, item_id) AS a, greatest(query_id, item_id) AS b, score FROM r WHERE rank <= 10) GROUP BY a, b")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    return gt.unordered_pairs(search.knn(*vectors(spark, sf), 10))


@register("j10_symmetric_edges", f"WITH {KNN}, e AS (SELECT DISTINCT least(query_id, item_id) AS a, greatest(query_id, item_id) AS b FROM r WHERE rank <= 10 AND score >= 0.2) SELECT a AS query_id, b AS item_id FROM e UNION SELECT b, a FROM e")
def j10(spark: SparkSession, sf: str) -> DataFrame:
    return gt.symmetric(gt.unordered_pairs(search.knn(*vectors(spark, sf), 10)).where("score >= 0.2"), "a", "b")


@register("j11_prefix_resolution", "WITH s AS (SELECT DISTINCT substr(url, 1, 22) AS short FROM pages) SELECT short, coalesce(min(p.url), short) AS resolved FROM s LEFT JOIN pages p ON starts_with(p.url, s.short) GROUP BY short")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return gt.resolve_prefixes(pages.select(F.substring("url", 1, 22).alias("short")).distinct(), pages.select(F.col("url").alias("full")))


@register("x13_vector_math", "SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS dot, round(sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS norm, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x13(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    a, b = F.col("embedding"), F.col("next")
    return e.join(n, "vec_id").select("vec_id", F.round(dot(a, b), 6).alias("dot"), F.round(norm(a), 6).alias("norm"), F.round(cosine(a, b), 6).alias("cosine"))


@register(
    "x14_concat_vectors",
    """WITH f AS (SELECT a.vec_id, list_concat(CAST(a.embedding AS DOUBLE[]), coalesce(CAST(b.embedding AS DOUBLE[]), list_transform(range(64), lambda x: 0.0::DOUBLE))) AS v FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, CAST(len(v) AS INTEGER) AS dim, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(v[128] / sqrt(list_inner_product(v, v)), 6) AS last FROM f""",
)
def x14(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    both = e.join(n, "vec_id", "left").select("vec_id", fused(F.col("embedding"), 64, F.col("next"), 64).alias("v"))
    return both.select("vec_id", F.size("v").alias("dim"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(127)), 6).alias("last"))


for _k in metrics.CUTS:  # R8, R9 and R11 at each cut, R10 and R12 in the report

    @register(f"r8_r9_r11_at_{_k}", f"WITH {KNN}, rr AS (SELECT * FROM r WHERE rank <= 20), {TRUTH}, {metric_sql('rr')} SELECT query_id, recall_{_k}, hit_{_k}, ndcg_{_k} FROM m")
    def at_k(spark: SparkSession, sf: str, k: int = _k) -> DataFrame:
        return metrics.per_query(search.knn(*vectors(spark, sf), 20), same_label(spark, sf)).select("query_id", f"recall_{k}", f"hit_{k}", f"ndcg_{k}")


@register("r10_r12_rr_ap", f"WITH {KNN}, rr AS (SELECT * FROM r WHERE rank <= 20), {TRUTH}, {metric_sql('rr')} SELECT query_id, rr, ap FROM m")
def r10(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.per_query(search.knn(*vectors(spark, sf), 20), same_label(spark, sf)).select("query_id", "rr", "ap")


@register(
    "r13_evaluation_report",
    f"WITH {KNN}, rr AS (SELECT * FROM r WHERE rank <= 20), {TRUTH}, {metric_sql('rr')} SELECT CASE WHEN grouping(query_label) = 1 THEN 'all' ELSE CAST(query_label AS VARCHAR) END AS category, count(*) AS n_queries, {MEANS} FROM m JOIN q ON m.query_id = q.query_id GROUP BY GROUPING SETS ((query_label), ())",
)
def r13(spark: SparkSession, sf: str) -> DataFrame:
    q, c = vectors(spark, sf)
    m = metrics.per_query(search.knn(q, c, 20), same_label(spark, sf)).join(q.select("query_id", F.col("query_label").alias("category")), "query_id")
    return metrics.by_category(m, "category")


def same_source(spark: SparkSession, sf: str, width: int = 256) -> metrics.Grouped:
    """A second ground truth: vectors of documents of the query's source and language, graded by whether the lengths are alike.

    How many lengths of a group are alike comes from running sums of counts by length, in ranges of ``width`` lengths, so no pair is made.
    """
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("long").alias("n")).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    d = cut(d.where("source IS NOT NULL AND lang IS NOT NULL"), "documents")
    group, asked = ["source", "lang"], d.where("doc_id % 20 = 0")
    ends = asked.where("n >= 0").select(*group, "n").distinct().withColumns({"low": F.floor((F.col("n") + 1) / 2) - 1, "high": F.floor(F.col("n") * 3 / 2)})
    counts = d.where("n IS NOT NULL").groupBy(*group, F.col("n").alias("x")).agg(F.count("*").alias("c"))
    bounds = ends.select(*group, F.explode(F.array("low", "high")).alias("x")).distinct().withColumn("c", F.lit(0).cast("long"))
    both = counts.unionByName(bounds).groupBy(*group, "x").agg(F.sum("c").alias("c")).withColumn("range", F.floor(F.col("x") / width))
    inside = both.withColumn("inside", F.sum("c").over(Window.partitionBy(*group, "range").orderBy("x")))
    ranges = both.groupBy(*group, "range").agg(F.sum("c").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    upto = inside.join(ranges.select(*group, "range", "before"), [*group, "range"]).select(*group, "x", (F.col("before") + F.col("inside")).alias("upto"))
    at = lambda c: upto.select(*group, F.col("x").alias(c), F.col("upto").alias(f"to_{c}"))
    alike = ends.join(at("low"), [*group, "low"]).join(at("high"), [*group, "high"]).select(*group, "n", (F.col("to_high") - F.col("to_low") - 1).alias("alike"))  # a query is like itself
    sizes = d.groupBy(*group).agg((F.count("*") - 1).alias("n_rel"))
    k = max(metrics.CUTS)
    some = F.least(F.coalesce("alike", F.lit(0)), F.lit(k)).cast("int")
    best = F.concat(F.array_repeat(F.lit(3), some), F.array_repeat(F.lit(1), (F.least(F.col("n_rel"), F.lit(k)) - some).cast("int")))
    wanted = asked.join(sizes, group).join(alike, [*group, "n"], "left").where("n_rel > 0").select(F.col("doc_id").alias("query_id"), "n_rel", best.alias("best"))

    def judged(rows: DataFrame) -> DataFrame:
        of = lambda side, key: d.select(F.col("doc_id").alias(key), *[F.col(c).alias(f"{side}_{c}") for c in (*group, "n")])
        met = rows.join(of("a", "query_id").where("query_id % 20 = 0"), "query_id").join(of("b", "item_id"), "item_id").where("a_source = b_source AND a_lang = b_lang AND query_id <> item_id")
        return met.select(*rows.columns, F.when(F.abs(F.col("a_n") - F.col("b_n")) * 2 <= F.col("a_n"), 3).otherwise(1).alias("relevance"))

    ids = d.join(asked.select(*group).distinct().join(sizes.where("n_rel > 0"), group), group, "left_semi").select(F.col("doc_id").alias("item_id"))
    return metrics.Grouped(wanted, judged, ids)


TRUTH_2 = """d AS (SELECT doc_id, source, lang, n_chars AS n FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
t AS (SELECT a.doc_id AS query_id, b.doc_id AS item_id, CASE WHEN abs(a.n - b.n) * 2 <= a.n THEN 3 ELSE 1 END AS relevance FROM d a JOIN d b ON a.doc_id % 20 = 0 AND a.source = b.source AND a.lang = b.lang AND a.doc_id <> b.doc_id)"""


def compared(name: str, truth_sql: str) -> str:
    """Both models against one ground truth, over the items that it names, as SQL."""
    return f"""SELECT * FROM (WITH q AS (SELECT vec_id AS query_id, label AS query_label FROM embeddings WHERE vec_id % 20 = 0), {truth_sql}, ids AS (SELECT query_id AS id FROM t UNION SELECT item_id FROM t),
v AS (SELECT 'full' AS model, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IN (SELECT id FROM ids) UNION ALL SELECT 'half', vec_id, list_slice(CAST(embedding AS DOUBLE[]), 1, 32) FROM embeddings WHERE vec_id IN (SELECT id FROM ids)),
sv AS (SELECT a.model, a.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.model = b.model AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
bothm AS (SELECT model, query_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, item_id) AS rank FROM sv) WHERE rank <= 20),
{metric_sql("bothm", "model, query_id")}
SELECT '{name}' AS truth, model, (SELECT count(*) FROM ids) AS n_items, count(*) AS n_queries, {", ".join(f"round(avg({c}) * 100, 1)::DOUBLE AS {c}" for k in metrics.CUTS for c in (f"recall_{k}", f"hit_{k}", f"ndcg_{k}"))}, round(avg(rr) * 100, 1)::DOUBLE AS rr, round(avg(ap) * 100, 1)::DOUBLE AS ap FROM m GROUP BY model)"""


@register("r14_model_comparison", compared("label", TRUTH) + "\nUNION ALL " + compared("source", TRUTH_2))
def r14(spark: SparkSession, sf: str) -> DataFrame:
    """Two models against two ground truths, each over the items that the truth names, in percent."""
    q, c = vectors(spark, sf)
    half = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    return gt.compared_models({"full": (q, c), "half": (half(q), half(c))}, {"label": same_label(spark, sf), "source": same_source(spark, sf)})


@register(
    "w10_best_configuration",
    f"""WITH {KNN}, {TRUTH}, c AS (SELECT k.k, count(*) FILTER (t.item_id IS NOT NULL) / count(*) AS precision FROM (VALUES (1), (3), (5), (10)) k(k) JOIN r ON r.rank <= k.k LEFT JOIN t ON t.query_id = r.query_id AND t.item_id = r.item_id GROUP BY k.k)
SELECT k AS best_k, round(precision, 6) AS best_precision FROM c ORDER BY precision DESC, k LIMIT 1""",
)
def w10(spark: SparkSession, sf: str) -> DataFrame:
    found = cut(search.knn(*vectors(spark, sf), 10).select("query_id", "item_id", "rank"), "hits")  # read twice
    hits = found.join(same_label(spark, sf).judged(found).select("query_id", "item_id", "relevance"), ["query_id", "item_id"], "left")
    each = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)]))).where("rank <= k")
    return gt.best_of(each.groupBy("k").agg((F.count("relevance") / F.count("*")).alias("precision")), "k", "precision").select(F.col("k").alias("best_k"), F.round("precision", 6).alias("best_precision"))


@register(
    "r15_cross_table_knn",
    """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS item_id, round(list_cosine_similarity(list_reverse(CAST(q.embedding AS DOUBLE[])), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT query_id, item_id, score, rank FROM r WHERE rank <= 5""",
)
def r15(spark: SparkSession, sf: str) -> DataFrame:
    q, c = vectors(spark, sf)
    other = q.withColumn("embedding", F.reverse("embedding"))  # stands for the table of image vectors
    return search.knn(other, c, 5).select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@register("r16_approximate_knn")
def r16(spark: SparkSession, sf: str) -> DataFrame:
    return search.approximate_knn(*vectors(spark, sf), 10).select("query_id", "item_id", "score", "rank", "seen")


@register("r16_recall", "SELECT count(DISTINCT vec_id) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def r16b(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the approximate search finds at least 0.9 of the exact ten nearest of all queries."""
    exact = search.knn(*vectors(spark, sf), 10).select("query_id", "item_id")
    near = search.approximate_knn(*vectors(spark, sf), 10).select("query_id", "item_id", F.lit(1).alias("hit"))
    both = exact.join(near, ["query_id", "item_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@register("r3_bm25", f"WITH asked AS (SELECT -1 - item_id AS query_id, text FROM benchmark), corpus AS (SELECT doc_id AS item_id, text FROM documents), {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM bm) SELECT query_id, item_id, score, rank FROM r WHERE rank <= 10")
def r3(spark: SparkSession, sf: str) -> DataFrame:
    return search.best(search.bm25(*passages(spark, sf), k=10), 10).select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


TF = f"""
gq AS (SELECT query_id AS id, {TOKENS.format("text")} AS tk FROM asked), gd AS (SELECT item_id AS id, {TOKENS.format("text")} AS tk FROM corpus),
tq AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))) AS term FROM gq) GROUP BY ALL),
td AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))) AS term FROM gd) GROUP BY ALL),
vocab AS (SELECT term, sum(tf) AS total, count(*) AS df FROM td GROUP BY term ORDER BY total DESC, term LIMIT 5000),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus)) / (1 + df)) + 1 AS idf FROM vocab),
wq AS (SELECT id, term, tf * idf AS w FROM tq JOIN idf USING (term)), wd AS (SELECT id, term, tf * idf AS w FROM td JOIN idf USING (term)),
nq AS (SELECT id, sqrt(sum(w * w)) AS n FROM wq GROUP BY id), nd AS (SELECT id, sqrt(sum(w * w)) AS n FROM wd GROUP BY id),
tfs AS (SELECT wq.id AS query_id, wd.id AS item_id, round(sum(wq.w / nq.n * wd.w / nd.n), 6) AS score FROM wq JOIN wd USING (term) JOIN nq ON nq.id = wq.id JOIN nd ON nd.id = wd.id WHERE wq.id <> wd.id GROUP BY ALL)"""


@register("r2_tfidf", f"WITH asked AS (SELECT -1 - item_id AS query_id, text FROM benchmark), corpus AS (SELECT doc_id AS item_id, text FROM documents), {TF}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM tfs) SELECT query_id, item_id, score, rank FROM r WHERE rank <= 10")
def r2(spark: SparkSession, sf: str) -> DataFrame:
    return search.best(search.tfidf(*passages(spark, sf), k=10), 10).select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


HYBRID = f"""
both_ AS (SELECT d.doc_id AS item_id, d.text, CAST(e.embedding AS DOUBLE[]) AS e FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
corpus AS (SELECT item_id, text FROM both_), asked AS (SELECT item_id AS query_id, text FROM both_ WHERE item_id % 20 = 0), {BM25},
dense AS (SELECT a.item_id AS query_id, b.item_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM both_ a JOIN both_ b ON a.item_id % 20 = 0 AND a.item_id <> b.item_id),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM dense),
sc AS (SELECT query_id, item_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS scaled FROM dr WHERE rank <= 100 WINDOW w AS (PARTITION BY query_id)),
top AS (SELECT query_id, coalesce(max(score) FILTER (score > 0), 1.0) AS top FROM bm GROUP BY query_id),
mixed AS (SELECT a.alpha, sc.query_id, sc.item_id, round(a.alpha * sc.scaled + (1 - a.alpha) * coalesce(bm.score / top.top, 0.0), 6) AS score
  FROM sc CROSS JOIN (VALUES (1.0::DOUBLE), (0.7::DOUBLE), (0.5::DOUBLE), (0.3::DOUBLE), (0.0::DOUBLE)) a(alpha) LEFT JOIN bm ON bm.query_id = sc.query_id AND bm.item_id = sc.item_id LEFT JOIN top ON top.query_id = sc.query_id),
hr AS (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, item_id) AS rank FROM mixed)"""


@register("r4_hybrid_fusion", f"WITH {HYBRID} SELECT alpha, query_id, item_id, score, rank FROM hr WHERE rank <= 20")
def r4(spark: SparkSession, sf: str) -> DataFrame:
    q, c = hybrid_inputs(spark, sf)
    dense = cut(search.knn(q, c, 100), "dense")
    return search.fuse(dense, search.bm25(q, c, wanted=dense), [1.0, 0.7, 0.5, 0.3, 0.0]).withColumn("rank", F.col("rank").cast("long"))


@register(
    "r1_two_stage",
    """WITH both_ AS (SELECT d.doc_id AS item_id, d.text, CAST(e.embedding AS DOUBLE[]) AS e FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
dense AS (SELECT a.item_id AS query_id, b.item_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM both_ a JOIN both_ b ON a.item_id % 20 = 0 AND a.item_id <> b.item_id),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM dense WHERE score >= 0.1),
w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM both_),
s2 AS (SELECT dr.query_id, dr.item_id, dr.score AS first_score, round(len(list_intersect(a.w, b.w)) / len(a.w), 6) AS score FROM dr JOIN w a ON a.item_id = dr.query_id JOIN w b ON b.item_id = dr.item_id WHERE rank <= 100),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_score DESC, item_id) AS rank FROM s2) SELECT query_id, item_id, first_score, score, rank FROM r WHERE rank <= 20""",
)
def r1(spark: SparkSession, sf: str) -> DataFrame:
    q, c = hybrid_inputs(spark, sf)
    return search.two_stage(search.knn(q, c, 100, threshold=0.1), q, c, 20).withColumn("rank", F.col("rank").cast("long"))


def units_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("unit_small"), F.col("lang").alias("unit_medium"), (F.col("n_chars") % 2).cast("string").alias("unit_large"), (F.col("n_chars") % 3).cast("string").alias("difficulty"))


ALIKE = " + ".join(f"CASE WHEN a.{c} = b.{c} AND a.{c} <> '' THEN {w} ELSE 0 END" for c, w in (("source", 0.4), ("lang", 0.3), ("x", 0.2), ("y", 0.1)))


D = "d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(CAST(n_chars % 2 AS VARCHAR), '') AS x, coalesce(CAST(n_chars % 3 AS VARCHAR), '') AS y FROM documents)"


@register("r5_metadata_similarity", f"WITH {D} SELECT a.doc_id AS x, b.doc_id AS y, round(({ALIKE})::DOUBLE, 6) AS score FROM d a JOIN d b ON a.doc_id <> b.doc_id")
def r5_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with every other one, as the reference does, also with nothing in common."""
    return gt.metadata_matrix(units_of(spark, sf))


@register(
    "r5_metadata_classes",
    f"""WITH {D},
c AS (SELECT source, lang, x, y, min(doc_id) AS rep, count(*) AS n FROM d GROUP BY source, lang, x, y),
p AS (SELECT a.rep AS a, b.rep AS b, round(({ALIKE})::DOUBLE, 6) AS score FROM c a JOIN c b ON a.rep < b.rep OR (a.rep = b.rep AND a.n > 1))
SELECT 'member' AS kind, doc_id AS a, rep AS b, CAST(NULL AS DOUBLE) AS score FROM d JOIN c USING (source, lang, x, y) UNION ALL SELECT 'pair', a, b, score FROM p WHERE score > 0""",
)
def r5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of documents with anything in common: each document's class, and the scores of classes (of a class with itself: of its members)."""
    return gt.metadata_pairs(units_of(spark, sf))


@register("r5_metadata_nearest", "WITH p AS (SELECT a.doc_id AS query_id, b.doc_id AS item_id, round((CASE WHEN a.source = b.source THEN 0.4 ELSE 0 END + CASE WHEN a.lang = b.lang THEN 0.3 ELSE 0 END + CASE WHEN a.n_chars % 2 = b.n_chars % 2 THEN 0.2 ELSE 0 END + CASE WHEN a.n_chars % 3 = b.n_chars % 3 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS score FROM documents a JOIN documents b ON a.doc_id <> b.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM p WHERE score > 0) SELECT query_id, item_id, score, rank FROM r WHERE rank <= 20")
def r5(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's 20 nearest by metadata."""
    d = units_of(spark, sf)
    found = gt.metadata_nearest(d.withColumnRenamed("item_id", "query_id"), d, 20)
    return found.select("query_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@register(
    "r6_auto_ground_truth",
    f"""WITH asked AS (SELECT -1 - item_id AS query_id, text FROM benchmark), corpus AS (SELECT doc_id AS item_id, text FROM documents), {TF},
c AS (SELECT query_id, item_id, round(0.7 * score + 0.3 * CASE WHEN item_id % 10 = (-1 - query_id) % 10 THEN 0.4 ELSE 0 END, 4)::DOUBLE AS score FROM tfs),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM c WHERE score >= 0.05)
SELECT query_id, item_id, score, CASE WHEN rank <= 2 THEN 3 WHEN rank <= 4 THEN 2 ELSE 1 END AS relevance FROM r WHERE rank <= 5""",
)
def r6(spark: SparkSession, sf: str) -> DataFrame:
    unit = (-1 - F.col("query_id")) % 10, F.col("item_id") % 10  # stands for a unit
    same = F.when(unit[0] == unit[1], 0.4).otherwise(0.0)
    found = search.tfidf(*passages(spark, sf), k=5, units=(*unit, 0.12 / 0.7))
    return gt.auto_truth(found.withColumn("meta", same)).select("query_id", "item_id", "score", "relevance")


@register(
    "r7_judgment_ingestion",
    "WITH j AS (SELECT user_id AS query_id, event_id AS item_id, event_id AS position, CAST(value AS INTEGER) % 6 AS score FROM events WHERE event_type <> 'error'), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place FROM j WHERE score >= 3) SELECT query_id, item_id, score AS relevance FROM r WHERE place <= 5",
)
def r7(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "events").where("event_type <> 'error'").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item_id"), F.col("event_id").alias("position"), (F.bround("value", 0).cast("int") % 6).alias("relevance_score"))
    return gt.from_judgments(j)


@register(
    "r17_search_with_fallback",
    f"""WITH {KNN}, v AS (SELECT CAST(query_id AS BIGINT) AS query_id, CAST(item_id AS BIGINT) AS item_id, score FROM r WHERE rank <= 5),
f AS (SELECT DISTINCT b.item_id AS bid, unnest(string_split(b.text, ' ')) AS word FROM benchmark b WHERE b.item_id % 20 <> 0),
k AS (SELECT f.bid, f.word, d.doc_id, row_number() OVER (PARTITION BY f.bid, f.word ORDER BY d.doc_id) AS n FROM f JOIN documents d ON d.text ILIKE '%' || f.word || '%'),
h AS (SELECT DISTINCT bid, doc_id FROM k WHERE n <= 5), o AS (SELECT bid, doc_id, row_number() OVER (PARTITION BY bid ORDER BY doc_id) AS n FROM h)
SELECT query_id, item_id, score, 'vector' AS path FROM v UNION ALL SELECT bid, doc_id, 0.8::DOUBLE, 'keyword' FROM o WHERE n <= 5""",
)
def r17(spark: SparkSession, sf: str) -> DataFrame:
    q, c = vectors(spark, sf)
    words = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.split("text", " ")).alias("word"))
    asked = q.select("query_id", "embedding").join(words, "query_id", "full")
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return gt.search_or_keyword(asked, c, items, 5)


@register("l5_batch_search", f"WITH {KNN} SELECT b.vec_id AS query_id, coalesce(string_agg(CAST(r.item_id AS VARCHAR), ',' ORDER BY r.rank), '') AS items FROM embeddings b LEFT JOIN r ON r.query_id = b.vec_id AND r.rank <= 3 WHERE b.vec_id % 10 = 0 GROUP BY b.vec_id")
def l5(spark: SparkSession, sf: str) -> DataFrame:
    q, c = vectors(spark, sf)  # every other query of the batch has no vector and comes back empty
    asked = table(spark, sf, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"))
    return gt.batch(asked, search.knn(q, c, 3))


@register("u1_truth_intersection", f"WITH {KNN}, {TRUTH}, a AS (SELECT query_id, item_id FROM r WHERE rank <= 20) SELECT t.query_id, t.item_id, t.relevance FROM t JOIN a ON a.query_id = t.query_id AND a.item_id = t.item_id")
def u1(spark: SparkSession, sf: str) -> DataFrame:
    return gt.intersection(search.knn(*vectors(spark, sf), 20), truth(spark, sf)).withColumn("relevance", F.col("relevance").cast("long"))


@register(
    "a19_truth_statistics",
    f"WITH {KNN}, {TRUTH}, c AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1) SELECT (SELECT count(*) FROM c) AS queries, (SELECT count(*) FROM t) AS pairs, round(avg(n), 6) AS mean, min(n) AS low, max(n) AS high, (SELECT count(*) FROM t WHERE relevance = 1) AS grade_1, (SELECT count(*) FROM t WHERE relevance = 2) AS grade_2, (SELECT count(*) FROM t WHERE relevance = 3) AS grade_3 FROM c",
)
def a19(spark: SparkSession, sf: str) -> DataFrame:
    return gt.statistics(truth(spark, sf))


@register("f9_restrict_to_truth", f"WITH {KNN}, {TRUTH} SELECT vec_id AS item_id, label FROM embeddings WHERE vec_id IN (SELECT query_id FROM t WHERE relevance = 3 UNION SELECT item_id FROM t WHERE relevance = 3)")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    _, c = vectors(spark, sf)
    return gt.restrict(c.select("item_id", "label"), truth(spark, sf).where("relevance = 3"))


@register("j15_model_deltas", f"WITH {KNN}, s5 AS (SELECT query_label, round(avg(score), 6) AS v FROM r WHERE rank <= 5 GROUP BY 1), s10 AS (SELECT query_label, round(avg(score), 6) AS v FROM r WHERE rank <= 10 GROUP BY 1) SELECT s5.query_label AS metric, s5.v AS baseline, s10.v AS variant, round(s10.v - s5.v, 6) AS delta FROM s5 JOIN s10 USING (query_label)")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    q, c = vectors(spark, sf)
    hits = search.knn(q, c, 10).join(q.select("query_id", F.col("query_label").alias("metric")), "query_id")
    of = lambda k: hits.where(F.col("rank") <= k).groupBy("metric").agg(F.round(F.avg("score"), 6).alias("value"))
    return gt.deltas(of(5), of(10))


