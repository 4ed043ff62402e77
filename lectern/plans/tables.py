"""Filters, joins, upserts, aggregates, set operations and samples on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import items as I
from lectern.operators import relational as R
from lectern.operators import search
from lectern.plans.registry import register
from lectern.session import cut, scratch, table
from lectern.sources import items


def T(name: str):
    return lambda spark, sf: table(spark, sf, name)


docs, events, orders, lineitem, customer, part, nation = map(T, ("documents", "events", "orders", "lineitem", "customer", "part", "nation"))


@register("f1_point_lookup", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 17")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where("doc_id = 17").select("doc_id", "lang", "source")


@register("f2_keyword_search", "SELECT doc_id AS item_id, CAST(0.8 AS DOUBLE) AS score FROM documents WHERE text ILIKE '%eau_%' OR lang ILIKE '%eau_%' OR source ILIKE '%eau_%' ORDER BY doc_id LIMIT 10")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    return search.keyword(docs(spark, sf).withColumnRenamed("doc_id", "item_id"), "eau_", ["text", "lang", "source"], 10).select("item_id", "score")


@register("f3_score_threshold", "SELECT event_id, value FROM events WHERE value >= 90")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("value >= 90").select("event_id", "value")


@register("f4_curriculum_filter", "SELECT doc_id FROM documents WHERE starts_with(source, 'src1') AND contains(lang, 'e') AND NOT starts_with(CAST(n_chars AS VARCHAR), '1')")
def f4(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where(F.col("source").startswith("src1") & F.col("lang").contains("e") & ~F.col("n_chars").cast("string").startswith("1")).select("doc_id")


@register("f5_distinct_tuples", "SELECT DISTINCT nullif(lang, '') AS lang, nullif(CAST(n_chars % 3 AS VARCHAR), '0') AS level FROM documents WHERE nullif(CAST(n_chars % 3 AS VARCHAR), '0') IS NOT NULL ORDER BY 1, 2")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select(F.nullif("lang", F.lit("")).alias("lang"), F.nullif((F.col("n_chars") % 3).cast("string"), F.lit("0")).alias("level"))
    return d.where("level IS NOT NULL").distinct().orderBy("lang", "level")


@register("f6_sampling_eligibility", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3') AND lang <> ''")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).where((F.col("doc_id") % 2 == 0) & F.col("lang").isin("en", "fr") & F.col("source").isin("src1", "src2", "src3") & (F.col("lang") != "")).select("doc_id")


@register("f7_metadata_filters", "SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' AND regexp_matches(p_name, '(?i)RING|widget') AND contains(p_brand, '1') ORDER BY p_partkey LIMIT 20")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).where((F.col("p_type") == "PROMO") & F.col("p_name").rlike("(?i)RING|widget") & F.col("p_brand").contains("1")).select("p_partkey", "p_name").orderBy("p_partkey").limit(20)


@register("f8_standards_filter", "SELECT p_partkey FROM part WHERE p_size = 11 AND starts_with(p_brand, 'Brand#2')")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).where((F.col("p_size") == 11) & F.col("p_brand").startswith("Brand#2")).select("p_partkey")


@register("j1_lineage_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def j1(spark: SparkSession, sf: str) -> DataFrame:
    o, c = orders(spark, sf), customer(spark, sf)
    return o.join(c, o["o_custkey"] == c["c_custkey"]).where("c_nationkey = 3").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", "c_name", "o_totalprice")


@register("j2_generated_listing", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def j2(spark: SparkSession, sf: str) -> DataFrame:
    o, c = orders(spark, sf), customer(spark, sf)
    return o.where("o_orderstatus = 'P'").join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_mktsegment")


@register("j3_hydrate", "SELECT l.doc_id, l.quality, d.lang, d.n_chars FROM (SELECT doc_id * 2 AS doc_id, quality FROM labels) l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("doc_id"), "quality")
    return R.hydrate(hits, docs(spark, sf).select("doc_id", "lang", "n_chars"), "doc_id")


@register("j4_three_way_join", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity = 50")
def j4(spark: SparkSession, sf: str) -> DataFrame:
    l, p, s = lineitem(spark, sf).where("l_quantity = 50"), part(spark, sf), table(spark, sf, "supplier")
    return l.join(p, l["l_partkey"] == p["p_partkey"]).join(s, l["l_suppkey"] == s["s_suppkey"]).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@register("j5_unmapped", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j5(spark: SparkSession, sf: str) -> DataFrame:
    return R.pending(docs(spark, sf), table(spark, sf, "labels"), "doc_id").select("doc_id", "lang")


@register("j6_resume", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    return R.pending(docs(spark, sf), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id").select("doc_id")


@register("j7_merged_hits", "WITH a AS (SELECT event_id AS item_id, row_number() OVER (ORDER BY event_id DESC) AS rank FROM events WHERE event_type = 'click' AND value > 200), b AS (SELECT event_id AS item_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events WHERE value > 100), u AS (SELECT item_id, 0 AS part, rank FROM a UNION ALL SELECT item_id, 1, rank FROM b WHERE item_id NOT IN (SELECT item_id FROM a)) SELECT item_id, CAST(row_number() OVER (ORDER BY part, rank, item_id) AS INTEGER) AS rank FROM u ORDER BY part, rank, item_id LIMIT 12")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumnRenamed("event_id", "item_id")
    first = e.where("event_type = 'click' AND value > 200").select("item_id", (-F.col("item_id")).cast("double").alias("rank"))
    then = e.where("value > 100").select("item_id", (-F.col("value")).alias("rank"))
    return R.merged_hits(first, then, 12)


@register("j12_leaf_test", "WITH p AS (SELECT DISTINCT p_type, p_brand, CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size % 5 AS VARCHAR) END AS s FROM part), k AS (SELECT p_type || '/' || p_brand || CASE WHEN s = '' THEN '' ELSE '/' || s END AS path FROM p) SELECT a.path, NOT EXISTS (SELECT 1 FROM k b WHERE starts_with(b.path, a.path || '/')) AS is_leaf FROM k a")
def j12(spark: SparkSession, sf: str) -> DataFrame:
    s = F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 5).cast("string"))
    p = part(spark, sf).select(F.array_compact(F.array("p_type", "p_brand", s)).alias("levels")).distinct()
    return R.leaves(p.withColumn("path", F.array_join("levels", "/")), "path", "levels").select("path", "is_leaf")


@register("j13_file_reconciliation", "WITH r AS (SELECT DISTINCT o_custkey AS k, 'f' || (o_orderkey % 500) AS name FROM orders), f AS (SELECT DISTINCT 'f' || (p_partkey * 3 % 500) AS name FROM part WHERE p_size > 25) SELECT k, coalesce(string_agg(r.name, ',' ORDER BY r.name) FILTER (f.name IS NOT NULL), '') AS verified, coalesce(string_agg(r.name, ',' ORDER BY r.name) FILTER (f.name IS NULL), '') AS missing FROM r LEFT JOIN f ON r.name = f.name GROUP BY k")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("f"), (c % 500).cast("string")).alias("name")
    refs = orders(spark, sf).select(F.col("o_custkey").alias("k"), name(F.col("o_orderkey")))
    files = part(spark, sf).where("p_size > 25").select(name(F.col("p_partkey") * 3))
    return R.reconcile(refs, files, "k").select("k", F.array_join("verified", ",").alias("verified"), F.array_join("missing", ",").alias("missing"))


@register("j16_zero_filled_grid", "SELECT l.lang, s.source, count(d.doc_id) AS n FROM (VALUES ('en'), ('fr'), ('xx')) l(lang) CROSS JOIN (VALUES ('src0'), ('src1'), ('none')) s(source) LEFT JOIN documents d ON d.lang = l.lang AND d.source = s.source GROUP BY ALL")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    return R.grid(docs(spark, sf), "lang", ["en", "fr", "xx"], "source", ["src0", "src1", "none"])


@register("s5_vector_read", "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS first, 'ids' AS named FROM embeddings UNION ALL SELECT row_number() OVER (ORDER BY vec_id) - 1, CAST(len(embedding) AS INTEGER), round(CAST(embedding[1] AS DOUBLE), 6), 'places' FROM embeddings")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    """The same vectors under two sets of names: with ids, and without, where the place in the file's order is the id."""
    e = table(spark, sf, "embeddings")
    named = items.vectors_of(e.select(F.col("vec_id").alias("item_ids"), F.col("label").alias("extra"), F.col("embedding").alias("embeddings")))
    placed = items.vectors_of(e.select(F.col("embedding").alias("whatever"), F.col("vec_id").alias("_order")), order="_order")
    shown = lambda df, name: df.select("id", F.size("embedding").alias("dim"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.lit(name).alias("named"))
    return shown(named, "ids").unionByName(shown(placed, "places"))


@register("s6_route_by_dimension", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'dim_32' WHEN vec_id % 3 = 1 THEN 'dim_64' ELSE 'other' END AS model FROM embeddings WHERE vec_id % 3 <> 0 OR label < 5")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    """A load of all vectors into a table for each length, then one of fewer short ones, which replaces their table only."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 32)).when(F.col("vec_id") % 3 == 1, F.col("embedding")).otherwise(F.slice("embedding", 1, 7)).alias("embedding"))
    path, routes = scratch(spark, "vectors"), {32: "dim_32", 64: "dim_64"}
    items.load_vectors(e.select("id", "embedding"), path, routes, "other")
    items.load_vectors(e.where("id % 3 = 0 AND label < 5").select("id", "embedding"), path, routes, "other")
    return spark.read.parquet(path).select("id", "model")


UP = "WITH n AS (SELECT l_orderkey AS id, l_linenumber AS seq, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2), o AS (SELECT o_orderkey AS id, 0 AS seq, o_totalprice AS price FROM orders)"


@register("s7_upsert", UP + ", u AS (SELECT *, 1 AS new FROM n UNION ALL SELECT *, 0 FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY new DESC, seq DESC) AS k FROM u) SELECT id, seq, price FROM r WHERE k = 1")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    """All lines as a load of changed and new rows into all orders."""
    old = orders(spark, sf).select(F.col("o_orderkey").alias("id"), F.lit(0).alias("seq"), F.col("o_totalprice").alias("price"))
    new = lineitem(spark, sf).groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq")).agg(F.max("l_extendedprice").alias("price"))
    return R.upsert(old, new, "id", "seq")


@register("s8_insert_ignore", "WITH o AS (SELECT s_suppkey AS id, CAST(0 AS BIGINT) AS seq, s_acctbal AS price FROM supplier), n AS (SELECT l_partkey AS id, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS seq, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM n WHERE id NOT IN (SELECT id FROM o)) SELECT id, seq, price FROM r WHERE k = 1 UNION ALL SELECT * FROM o")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    """All suppliers, and of all lines the first one of each part number that no supplier has."""
    old = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0).cast("long").alias("seq"), F.col("s_acctbal").alias("price"))
    new = lineitem(spark, sf).groupBy(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("seq")).agg(F.max("l_extendedprice").alias("price"))
    return R.insert_ignore(old, new, ["id"], "seq")


@register("s9_cascading_delete", "WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0) SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone) UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    o, l = orders(spark, sf), lineitem(spark, sf)
    left = R.cascade_delete({"orders": (o, "o_orderkey"), "lines": (l, "l_orderkey")}, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), F.col("id") % 2 == 0)
    count = lambda name: left[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("orders").unionByName(count("lines"))


@register("s10_vector_dimension_check", "SELECT vec_id, vec_id % 7 <> 0 AS accepted FROM embeddings")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    good, bad = R.split_by_dimension(e, [64])
    return good.select("vec_id", F.lit(True).alias("accepted")).union(bad.select("vec_id", F.lit(False)))


@register("a1_corpus_statistics", "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return R.value_counts(docs(spark, sf), ["lang", "source"])


FILES = """f AS (SELECT doc_id, lang, source, CASE WHEN n_chars > 5000 THEN 'long' WHEN n_chars > 500 THEN 'middle' ELSE '' END AS size,
list_filter([CASE WHEN n_chars < 100 THEN 'text of ' || n_chars || ' characters is too short in ' || source END, CASE WHEN contains(text, '[PHONE]') OR regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 'personal data' END], lambda x: x IS NOT NULL) AS errors FROM documents)"""


def file_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    short = F.when(n < 100, F.concat(F.lit("text of "), n.cast("string"), F.lit(" characters is too short in "), F.col("source")))
    personal = F.when(F.contains("text", F.lit("[PHONE]")) | F.col("text").rlike("[0-9]{3}-[0-9]{4}"), "personal data")
    return docs(spark, sf).select("doc_id", "lang", "source", F.when(n > 5000, "long").when(n > 500, "middle").otherwise("").alias("size"), F.array_compact(F.array(short, personal)).alias("errors"))


@register(
    "a2_parse_statistics",
    f"""WITH {FILES}, g AS (SELECT * FROM f WHERE len(errors) = 0), b AS (SELECT doc_id, substr(e, 1, 50) AS value FROM (SELECT doc_id, unnest(errors) AS e FROM f)),
d AS (SELECT DISTINCT doc_id, value FROM b QUALIFY row_number() OVER (PARTITION BY value ORDER BY doc_id) <= 100)
SELECT 'lang' AS field, coalesce(nullif(lang, ''), 'unknown') AS value, count(*) AS n, '' AS files FROM g GROUP BY 2 UNION ALL SELECT 'size', coalesce(nullif(size, ''), 'unknown'), count(*), '' FROM g GROUP BY 2
UNION ALL SELECT 'error', b.value, count(*), any_value(l.files) FROM b JOIN (SELECT value, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY doc_id) AS files FROM d GROUP BY value) l ON l.value = b.value GROUP BY b.value
UNION ALL SELECT 'total', 'scanned', count(*), '' FROM f UNION ALL SELECT 'total', 'good', count(*), '' FROM g UNION ALL SELECT 'total', 'bad', count(*), '' FROM f WHERE len(errors) > 0""",
)
def a2(spark: SparkSession, sf: str) -> DataFrame:
    """Good files by field, errors by their first 50 characters with the first 100 files of each, and totals."""
    return R.counters(file_rows(spark, sf), {"lang": F.col("lang"), "size": F.col("size")}, F.col("errors"), F.col("doc_id"))


@register("a3_row_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'labels', count(*) FROM labels")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name: table(spark, sf, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one("documents").unionByName(one("embeddings")).unionByName(one("labels"))


@register("a4_cross_tab", "SELECT CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN '*' ELSE source END AS source, count(*) AS n, count(*) FILTER (n_chars > 2000) AS n_flagged, round(count(*) FILTER (n_chars > 2000) / count(*) * 100, 6) AS percent, round(count(*) / (SELECT count(*) FROM documents) * 100, 6) AS share FROM documents GROUP BY ROLLUP (lang, source)")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return R.rolled_cross_tab(docs(spark, sf), "lang", "source", F.col("n_chars") > 2000)


@register("a5_pivot", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de FROM documents GROUP BY source")
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).groupBy("source").pivot("lang", ["en", "fr", "de"]).count().na.fill(0)


@register("a6_domain_consistency", "WITH g AS (SELECT p_type, p_brand, list_sort(list_distinct(list(CASE WHEN p_size % 10 = 0 THEN '(no chapter)' ELSE CAST(p_size % 10 AS VARCHAR) END))) AS c FROM part GROUP BY 1, 2) SELECT p_type, p_brand, array_to_string(c, ',') AS chapters, len(c) > 1 AS flagged FROM g")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    chapter = F.coalesce(F.nullif((F.col("p_size") % 10).cast("string"), F.lit("0")), F.lit("(no chapter)"))
    g = part(spark, sf).groupBy("p_type", "p_brand").agg(F.array_sort(F.collect_set(chapter)).alias("c"))
    return g.select("p_type", "p_brand", F.array_join("c", ",").alias("chapters"), (F.size("c") > 1).alias("flagged"))


@register(
    "a7_confidence_distribution",
    """WITH l AS (SELECT l_returnflag, l_discount * 10 AS c, l_orderkey AS o, l_linenumber AS k, l_partkey AS p FROM lineitem),
s AS (SELECT l_returnflag, o || '/' || k || '/' || p || '=' || printf('%.2f', c) AS shown, row_number() OVER (PARTITION BY l_returnflag ORDER BY o, k, p, c) AS n FROM l WHERE round(c, 6) < 0.5),
e AS (SELECT l_returnflag, string_agg(shown, '|' ORDER BY n) AS first_low FROM s WHERE n <= 10 GROUP BY 1)
SELECT l.l_returnflag, count(*) AS n, round(avg(c), 6) AS mean, round(min(c), 6) AS low, round(max(c), 6) AS high, count(*) FILTER (round(c, 6) < 0.5) AS n_low, coalesce(any_value(first_low), '') AS first_low FROM l LEFT JOIN e ON e.l_returnflag = l.l_returnflag GROUP BY 1""",
)
def a7(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence by subject, with the first ten low mappings of each."""
    l = lineitem(spark, sf).select("l_returnflag", (F.col("l_discount") * 10).alias("c"), "l_orderkey", "l_linenumber", "l_partkey")
    low = F.round("c", 6) < 0.5
    shown = F.concat_ws("/", "l_orderkey", "l_linenumber", F.concat(F.col("l_partkey").cast("string"), F.lit("="), F.format_string("%.2f", "c")))
    first = R.evidence(l.where(low), ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "c"], shown, 10, "first_low")
    each = l.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.min("c"), 6).alias("low"), F.round(F.max("c"), 6).alias("high"), F.count_if(low).alias("n_low"))
    return each.join(first, "l_returnflag", "left").na.fill("", ["first_low"])


@register("a8_coverage", "SELECT d.lang, round(avg(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END) * 100, 6) AS coverage, round(100.0 * count(DISTINCT CASE WHEN l.doc_id IS NOT NULL THEN d.source END) / count(DISTINCT d.source), 6) AS reverse_coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    got = docs(spark, sf).join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return got.groupBy("lang").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))) * 100, 6).alias("coverage"), F.round(100.0 * F.countDistinct(F.when(F.col("hit") == 1, F.col("source"))) / F.countDistinct("source"), 6).alias("reverse_coverage"))


@register("a9_latency_profile", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS low, max(value) AS high, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM events GROUP BY 1")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return R.latency_profile(events(spark, sf), "value", ["event_type"], F.col("value") < 50)


@register("a9_mergeable_profile", "SELECT event_type, count(*) AS n, true AS within FROM events WHERE value IS NOT NULL GROUP BY 1")
def a9_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles from sketches kept by day and merged by type, and whether each one's rank is within 2 % of what was asked."""
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    e = events(spark, sf).withColumn("day", F.to_date("ts"))
    kept = cut(R.quantile_sketches(e, "value", ["event_type", "day"]), "sketches")
    found = R.merged_profile(kept, ["event_type"], points)
    ranks = e.join(F.broadcast(found), "event_type").groupBy("event_type", "n").agg(*[(F.abs(F.count_if(F.col("value") <= F.col(c)) / F.count("value") - q) <= 0.02).alias(c) for c, q in points.items()])  # a row a type
    return ranks.select("event_type", "n", (F.col("p50") & F.col("p95") & F.col("p99")).alias("within"))


DAILY = "count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type <> 'error') AS successes, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, CAST(floor(sum(CAST(floor(value) AS BIGINT)) / count(*)) AS BIGINT) AS mean"


def daily(e: DataFrame, by) -> DataFrame:
    """Generations, failures, successes, total and floor-average duration."""
    whole = F.floor("value").cast("long")
    return e.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"), F.count_if(F.col("event_type") != "error").alias("successes"), F.sum(whole).alias("total"), F.floor(F.sum(whole) / F.count("*")).cast("long").alias("mean"))


@register("a10_daily_summary", f"SELECT strftime(ts, '%Y-%m-%d') AS day, {DAILY} FROM events GROUP BY 1")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return daily(events(spark, sf), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@register("a11_outcomes", "SELECT o_orderstatus AS status, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders) * 100, 6) AS percent FROM orders GROUP BY 1")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    n = orders(spark, sf).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return n.select("status", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))) * 100, 6).alias("percent"))  # a row a status


@register(
    "a12_conversion_report",
    """WITH d AS (SELECT doc_id, coalesce(nullif(lang, ''), '(unknown)') AS subject, CASE WHEN n_chars % 4 = 0 THEN '(unknown)' ELSE source END AS question_type, CASE WHEN n_chars > 2000 THEN 'hard' WHEN n_chars > 800 THEN 'middle' ELSE '(unknown)' END AS difficulty,
CASE WHEN n_chars > 500 THEN 'converted' WHEN n_chars > 100 THEN 'skipped' ELSE 'error' END AS outcome, 'only ' || n_chars || ' characters' AS why FROM documents),
c AS (SELECT * FROM d WHERE outcome = 'converted')
SELECT 'summary' AS section, outcome AS name, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'summary', 'scanned', count(*) FROM d UNION ALL SELECT 'by_subject', subject, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'by_question_type', question_type, count(*) FROM c GROUP BY 2
UNION ALL SELECT 'by_difficulty', difficulty, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'errors', doc_id || ': ' || why, 1 FROM (SELECT * FROM d WHERE outcome = 'error' ORDER BY doc_id LIMIT 100)""",
)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes, converted items by three fields with an unknown bucket, and the first 100 errors."""
    n, unknown = F.col("n_chars"), F.lit("(unknown)")
    d = docs(spark, sf).select(
        "doc_id", F.coalesce(F.nullif("lang", F.lit("")), unknown).alias("by_subject"), F.when(n % 4 == 0, unknown).otherwise(F.col("source")).alias("by_question_type"),
        F.when(n > 2000, "hard").when(n > 800, "middle").otherwise(unknown).alias("by_difficulty"), F.when(n > 500, "converted").when(n > 100, "skipped").otherwise("error").alias("outcome"),
        F.concat(F.lit("only "), n.cast("string"), F.lit(" characters")).alias("why"),
    )
    outcome = d.rollup("outcome").agg(F.count("*").alias("n")).select(F.lit("summary").alias("section"), F.coalesce("outcome", F.lit("scanned")).alias("name"), "n")
    by = R.value_counts(d.where("outcome = 'converted'"), ["by_subject", "by_question_type", "by_difficulty"]).select(F.col("field").alias("section"), F.col("value").alias("name"), "n")
    errors = d.where("outcome = 'error'").orderBy("doc_id").limit(100)
    return outcome.unionByName(by).unionByName(errors.select(F.lit("errors").alias("section"), F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.col("why")).alias("name"), F.lit(1).cast("long").alias("n")))


@register("a13_counts_by_id_part", "SELECT split_part(p_brand || '_' || p_type || '_' || p_partkey, '_', 2) AS subject, count(*) AS n FROM part GROUP BY 1")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("_", "p_brand", "p_type", F.col("p_partkey").cast("string"))
    return part(spark, sf).groupBy(F.split_part(name, F.lit("_"), F.lit(2)).alias("subject")).agg(F.count("*").alias("n"))


@register("a14_duplicate_audit", "WITH k AS (SELECT md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key, doc_id FROM documents WHERE length(text) > 20) SELECT key, count(*) AS n, array_to_string(list_slice(list_sort(list(doc_id)), 1, 5), ',') AS positions FROM k GROUP BY key HAVING count(*) > 1")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.functions.strings import collapse

    d = R.duplicates(docs(spark, sf).where(F.length("text") > 20), F.md5(collapse(F.col("text")).cast("binary")), "doc_id")
    return d.select("key", "n", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@register("a15_macro_averages", "SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS category, count(*) AS n_queries, round(avg(value), 6) AS value FROM events GROUP BY CUBE (event_type)")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.operators.metrics import by_category

    return by_category(events(spark, sf).select(F.col("event_type").alias("category"), "value"), "category")


@register("a16_distinct_sorted", "SELECT DISTINCT p_brand FROM part ORDER BY 1")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).select("p_brand").distinct().orderBy("p_brand")


@register("a17_keyword_coverage", "WITH k AS (SELECT * FROM (VALUES ('metal', 'ring'), ('metal', 'gear'), ('colour', 'red'), ('size', 'small')) v(subject, word)) SELECT p_type, string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects FROM part JOIN k ON contains(p_name, word) GROUP BY p_type")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    words = spark.createDataFrame([("metal", "ring"), ("metal", "gear"), ("colour", "red"), ("size", "small")], "subject string, word string")
    hit = part(spark, sf).join(F.broadcast(words), F.col("p_name").contains(F.col("word")))  # a fixed keyword table
    return hit.groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("subjects"))


@register("a18_step_counts", "SELECT conv_id, count(*) FILTER (role = 'system') AS system, count(*) FILTER (role = 'user') AS \"user\", count(*) FILTER (role = 'assistant') AS assistant FROM conversations GROUP BY conv_id")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").pivot("role", ["system", "user", "assistant"]).count().na.fill(0)


@register(
    "a20_validation_summary",
    """WITH d AS (SELECT doc_id, substr(text, 1, 100) AS preview, concat_ws(';', CASE WHEN n_chars < 200 THEN 'question_too_short:' || n_chars END, CASE WHEN contains(text, '<') THEN 'markup_in_text' END, CASE WHEN contains(text, chr(10)) AND n_chars > 3000 THEN 'too_long:' || n_chars END, CASE WHEN text IS NULL THEN 'no_text' END) AS errors FROM documents),
b AS (SELECT * FROM d WHERE errors <> ''), k AS (SELECT doc_id, split_part(unnest(string_split(errors, ';')), ':', 1) AS kind FROM b),
s AS (SELECT doc_id || ' ' || errors || ' ' || md5(preview) AS name, row_number() OVER (ORDER BY doc_id) AS n FROM b)
SELECT 'items' AS section, 'valid' AS name, count(*) FILTER (errors = '') AS n, round(count(*) FILTER (errors = '') / count(*) * 100, 6) AS rate FROM d UNION ALL SELECT 'items', 'invalid', count(*) FILTER (errors <> ''), round(count(*) FILTER (errors <> '') / count(*) * 100, 6) FROM d
UNION ALL SELECT 'errors', kind, count(*), NULL FROM k GROUP BY 2 UNION ALL SELECT 'samples', name, n, NULL FROM s WHERE n <= 10""",
)
def a20(spark: SparkSession, sf: str) -> DataFrame:
    """Valid and invalid items, errors by type (the part before the colon), and the first ten samples with what their text begins with."""
    n = F.col("n_chars").cast("string")
    errors = F.concat_ws(";", F.when(F.col("n_chars") < 200, F.concat(F.lit("question_too_short:"), n)), F.when(F.contains("text", F.lit("<")), "markup_in_text"), F.when(F.contains("text", F.lit("\n")) & (F.col("n_chars") > 3000), F.concat(F.lit("too_long:"), n)), F.when(F.col("text").isNull(), "no_text"))
    d = docs(spark, sf).select("doc_id", F.substring("text", 1, 100).alias("preview"), errors.alias("errors"))
    bad = d.where("errors <> ''")
    rate = lambda c: F.round(F.count_if(c) / F.count("*") * 100, 6)
    ok = F.col("errors") == ""
    items_ = d.agg(F.count_if(ok).alias("a"), F.count_if(~ok).alias("b"), rate(ok).alias("c"), rate(~ok).alias("d")).select(F.inline(F.array(*[F.struct(F.lit("items").alias("section"), F.lit(x).alias("name"), F.col(y).alias("n"), F.col(z).alias("rate")) for x, y, z in (("valid", "a", "c"), ("invalid", "b", "d"))])))
    none = F.lit(None).cast("double").alias("rate")
    kinds = bad.select(F.explode(F.split("errors", ";")).alias("e")).groupBy(F.split_part("e", F.lit(":"), F.lit(1)).alias("name")).agg(F.count("*").alias("n")).select(F.lit("errors").alias("section"), "name", "n", none)
    first = bad.orderBy("doc_id").limit(10).withColumn("n", F.row_number().over(Window.orderBy("doc_id")).cast("long"))  # ten rows
    samples = first.select(F.lit("samples").alias("section"), F.concat_ws(" ", F.col("doc_id").cast("string"), "errors", F.md5(F.col("preview").cast("binary"))).alias("name"), "n", none)
    return items_.unionByName(kinds).unionByName(samples)


@register("a21_judging_cost", "SELECT event_type, CAST(sum(user_id * 10) AS BIGINT) AS tokens_in, CAST(sum(user_id) AS BIGINT) AS tokens_out, round(sum(user_id * 10) * 0.15 / 1000000 + sum(user_id) * 0.6 / 1000000, 6) AS cost FROM events GROUP BY 1")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).groupBy("event_type").agg(F.sum(F.col("user_id") * 10).alias("tokens_in"), F.sum("user_id").alias("tokens_out"))
    return e.select("*", F.round(F.col("tokens_in") * 0.15 / 1000000 + F.col("tokens_out") * 0.6 / 1000000, 6).alias("cost"))


@register("l1_top_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def l1(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@register("l2_stratified_sample")
def l2(spark: SparkSession, sf: str) -> DataFrame:
    return R.stratified(docs(spark, sf).select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 3)


@register("l2_stratum_sizes", "WITH g AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) SELECT lang, source, least(n, 3) AS n FROM g")
def l2b(spark: SparkSession, sf: str) -> DataFrame:
    return l2(spark, sf).groupBy("lang", "source").agg(F.count("*").alias("n"))


@register("l3_quota_sample")
def l3(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", "lang", "source")
    return R.quota(d, "lang", "source", {"en": 50, "fr": 30, "de": 20}, "doc_id")


@register("l3_quota_sizes", "SELECT lang, CAST(least(quota, count(*)) AS BIGINT) AS n FROM documents JOIN (VALUES ('en', 50), ('fr', 30), ('de', 20)) v(lang, quota) USING (lang) GROUP BY lang, quota")
def l3b(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows the quota sample has of each category: its quota, or all there are."""
    return l3(spark, sf).groupBy("lang").agg(F.count("*").alias("n"))


@register("l4_first_n", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 10")
def l4(spark: SparkSession, sf: str) -> DataFrame:
    return R.first_n(events(spark, sf).select("event_type", "event_id"), ["event_type"], "event_id", 10)


@register("w7_sequential_ids", "WITH d AS (SELECT DISTINCT p_type, p_brand FROM part) SELECT printf('tb_%s_%03d', p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_brand)) AS id, p_type, p_brand FROM d")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    return R.numbered(part(spark, sf).select("p_type", "p_brand").distinct(), "p_type", ["p_brand"], "tb").select("id", "p_type", "p_brand")


@register("w8_dedup_by_path", "SELECT regexp_replace(lower(p_name), '\\s+', '', 'g') AS key, arg_min(p_name, p_partkey) AS first, array_to_string(list_sort(list_distinct(list(p_name))), '|') AS variants FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '  ') END AS p_name FROM part) GROUP BY 1")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    p = part(spark, sf).select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("  "))).alias("p_name"))
    return R.distinct_by(p, F.regexp_replace(F.lower("p_name"), r"\s+", ""), "p_name", "p_partkey").select("key", "first", F.array_join("variants", "|").alias("variants"))


@register("p11_hierarchy_path", "SELECT n_nationkey, r_name || ' > ' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE ' > leaf' END AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    n, r = nation(spark, sf), table(spark, sf, "region")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    leaf = F.when(F.col("n_nationkey") % 3 != 0, "07 leaf")
    return j.select("n_nationkey", I.path_of([F.concat(F.lit("01 "), "r_name"), F.lit(""), F.concat(F.lit("12  "), "n_name"), leaf]).alias("path"))


@register("p12_hierarchy_depth", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 4 = 0 THEN 2 WHEN p_size % 5 = 0 THEN 3 ELSE 4 END::BIGINT AS depth FROM part")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    empty = lambda m, c: F.when(F.col("p_size") % m != 0, F.col(c))
    return part(spark, sf).select("p_partkey", I.depth_of([F.col("p_type"), empty(3, "p_brand"), empty(4, "p_name"), empty(5, "p_name")]).alias("depth"))


@register("s3_schema_discovery", "WITH tags AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z0-9]+)', 1)) AS tag FROM pages) SELECT lower(tag) AS tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM tags GROUP BY 1")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z0-9]+)"), F.lit(1))).alias("tag"))
    return t.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@register("s3_attribute_samples", "WITH a AS (SELECT DISTINCT lower(regexp_extract(m, '^([a-z]+)', 1)) AS attr, substr(regexp_extract(m, '\"(.*)\"', 1), 1, 100) AS value FROM (SELECT unnest(regexp_extract_all(html, '[a-z]+=\"[^\"]*\"')) AS m FROM pages)), r AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY value) AS n FROM a) SELECT attr, value FROM r WHERE n <= 20")
def s3b(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('([a-z]+="[^"]*")'), F.lit(1))).alias("m"))
    a = m.select(F.regexp_extract("m", "^([a-z]+)", 1).alias("attr"), F.substring(F.regexp_extract("m", '"(.*)"', 1), 1, 100).alias("value")).distinct()
    return R.first_n(a, ["attr"], "value", 20)


@register("s13_header_prefilter", "SELECT page_id, regexp_extract(substr(html, 1, 200), '<title>([^<]*)', 1) AS title FROM pages WHERE regexp_matches(substr(html, 1, 200), 'lang=\"(fr|de)\"')")
def s13(spark: SparkSession, sf: str) -> DataFrame:
    head = F.substring("html", 1, 200)
    return table(spark, sf, "pages").where(head.rlike('lang="(fr|de)"')).select("page_id", F.regexp_extract(head, "<title>([^<]*)", 1).alias("title"))


@register("u2_common_queries", "SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 0")
def u2(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels")
    return l.where("quality = 1").select("doc_id").intersect(l.where("toxic = 0").select("doc_id"))


@register("u3_corpus_union", "SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier")
def u3(spark: SparkSession, sf: str) -> DataFrame:
    c = customer(spark, sf).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))


@register("u4_distinct_union", "SELECT lang AS value FROM documents UNION SELECT source FROM documents UNION SELECT role FROM conversations")
def u4(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    return d.select(F.col("lang").alias("value")).union(d.select("source")).union(table(spark, sf, "conversations").select("role")).distinct()


@register("u5_last_write_index", "SELECT p_brand AS code, arg_max(p_name, p_partkey) AS name FROM part GROUP BY p_brand")
def u5(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).groupBy(F.col("p_brand").alias("code")).agg(F.max_by("p_name", "p_partkey").alias("name"))


@register("u6_overlap_size", "WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey % 20) AS x, list(DISTINCT l_suppkey % 20) AS y FROM lineitem GROUP BY 1) SELECT k, CAST(len(list_intersect(x, y)) AS INTEGER) AS overlap FROM a")
def u6(spark: SparkSession, sf: str) -> DataFrame:
    a = lineitem(spark, sf).groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_partkey") % 20).alias("x"), F.collect_set(F.col("l_suppkey") % 20).alias("y"))
    return a.select("k", F.size(F.array_intersect("x", "y")).alias("overlap"))


@register("u7_array_equality", "WITH a AS (SELECT l_orderkey AS k, list_sort(list(l_returnflag)) AS x, list_sort(list(CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END)) AS y FROM lineitem GROUP BY 1) SELECT k, x = y AS same FROM a")
def u7(spark: SparkSession, sf: str) -> DataFrame:
    other = F.when(F.col("l_linestatus") == "F", "A").otherwise("N")
    a = lineitem(spark, sf).groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_returnflag").alias("x"), F.collect_list(other).alias("y"))
    return a.select("k", (F.array_sort("x") == F.array_sort("y")).alias("same"))


@register("t6_chat_history", "SELECT conv_id, turn, coalesce(string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations")
def t6(spark: SparkSession, sf: str) -> DataFrame:
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(before), ">").alias("history"))
