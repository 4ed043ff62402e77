"""Streaming jobs, sinks and batch encoding on the driver's tables; streams read the same files and must equal the batch result."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.registry import register
from lectern.plans.tables import DAILY
from lectern.session import scratch, table
from lectern.sources import encode, items
from lectern.streaming import jobs


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The table's files as a stream, times as timestamps. The glob serves files and folders alike."""
    rows = jobs.read(spark, f"{sf}/{name}[.]parquet", table(spark, sf, name).schema)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def closed(spark: SparkSession, sf: str, events: DataFrame, job: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Run ``job`` in append mode over all events, then once more with a tick well after the last of them, which closes what is still open."""
    jobs.tick(spark, f"{path}/ticks", datetime.datetime(1970, 1, 1))
    for last in (False, True):
        if last:
            end = table(spark, sf, "events").agg(F.max("ts").cast("timestamp").alias("ts")).head().ts
            jobs.tick(spark, f"{path}/ticks", (end or datetime.datetime(1970, 1, 1)) + datetime.timedelta(days=4))
        jobs.appended(job(jobs.with_ticks(events, f"{path}/ticks")), f"{path}/data", f"{path}/checkpoint")


@register("t1_stream_upsert", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id, value FROM r WHERE n = 1")
def t1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "upserts")
    target = jobs.UpsertedTable(spark, f"{path}/data", "user_id", "event_id")
    jobs.run(stream(spark, sf, "events").select("user_id", "event_id", "value"), target.take, f"{path}/checkpoint")
    return target.read()


@register("t2_stream_vectorise", "SELECT conv_id * 1000 + turn AS id, 64 AS dim, false AS failed FROM conversations")
def t2(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "vectors")
    jobs.vectorise_backlog(stream(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"), f"{path}/data", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/data").select("id", F.size("embedding").alias("dim"), F.col("error").isNotNull().alias("failed"))


@register("t3_stream_daily_summary", f"SELECT strftime(ts, '%Y-%m-%d') AS day, {DAILY} FROM events GROUP BY 1")
def t3(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "daily")
    closed(spark, sf, stream(spark, sf, "events").select("ts", "event_type", "value"), jobs.daily_summary, path)
    return spark.read.parquet(f"{path}/data")


@register("t4_stream_response_state", "WITH e AS (SELECT user_id AS session_id, event_type AS response_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT session_id, response_id, value FROM e WHERE n = 1 AND value IS NOT NULL")
def t4(spark: SparkSession, sf: str) -> DataFrame:
    e = stream(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("response_id"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), "ts", "event_id")
    path = scratch(spark, "state")
    jobs.response_state(e, f"{path}/data", f"{path}/checkpoint")
    return jobs.responses(spark, f"{path}/data")


@register("t5_stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 360 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def t5(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "sessions")
    closed(spark, sf, stream(spark, sf, "events").select("user_id", "ts"), lambda e: jobs.sessions(e, "360 minutes"), path)
    found = spark.read.parquet(f"{path}/data")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return found.select("user_id", shown("started"), shown("ended"), "n")


@register("r18_batch_vectorise", "SELECT doc_id AS id, CASE WHEN coalesce(text, '') <> '' THEN 64 END AS dim, coalesce(text, '') = '' AS failed FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def r18(spark: SparkSession, sf: str) -> DataFrame:
    """In two runs on one folder: the second goes on with what the first, of the even ids, hasn't done."""
    done = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    todo = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").join(done, "id", "left_anti")
    path = f"{scratch(spark, 'vectors')}/data"
    encode.vectorise_to(path, todo.where("id % 2 = 0"))
    return encode.vectorise_to(path, todo).select("id", F.size("embedding").alias("dim"), F.col("error").isNotNull().alias("failed"))


@register("s1_file_scan")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    return items.files(spark, sf, "*.[pP][aA][rR][qQ][uU][eE][tT]").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


@register("s11_report_sinks", "SELECT lang, count(*) AS n, 3 AS copies FROM documents GROUP BY lang")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "reports")
    items.write_reports(table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")), path)
    kinds = [spark.read.schema("lang string, n long").json(f"{path}/json"), spark.read.schema("lang string, n long").csv(f"{path}/csv", header=True), spark.read.parquet(f"{path}/parquet")]
    every = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    return every.groupBy("lang", "n").agg(F.count("*").cast("int").alias("copies"))


@register(
    "s11_star_export",
    """WITH m AS (SELECT l_partkey AS t, l_suppkey AS s, max(l_discount) AS c FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2)
SELECT 'star' AS part, p_brand AS name, count(*) AS n, round(avg(c), 6) AS confidence FROM m JOIN part ON t = p_partkey JOIN supplier ON s = s_suppkey GROUP BY 2
UNION ALL SELECT 'csv', p_brand, count(*), round(avg(c), 6) FROM m JOIN part ON t = p_partkey JOIN supplier ON s = s_suppkey GROUP BY 2
UNION ALL SELECT 'unmapped', s_name, 1, NULL FROM supplier WHERE s_suppkey NOT IN (SELECT s FROM m)
UNION ALL SELECT 'meta', 'textbooks', count(*), NULL FROM part UNION ALL SELECT 'meta', 'standards', count(*), NULL FROM supplier UNION ALL SELECT 'meta', 'mappings', count(*), NULL FROM m
UNION ALL SELECT 'meta', 'unmapped_standards', count(*), NULL FROM supplier WHERE s_suppkey NOT IN (SELECT s FROM m)""",
)
def s11_star(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as textbooks, suppliers as standards, lines as mappings: written as a star and a quoted file, read back and joined by their keys."""
    path = scratch(spark, "star")
    textbooks = table(spark, sf, "part").select(F.col("p_partkey").alias("textbook_id"), F.col("p_brand").alias("subject"), F.concat_ws(" > ", "p_type", "p_name").alias("full_path"), F.lit(True).alias("is_leaf"))
    standards = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("standard_code"), F.col("s_name").alias("description"), F.col("s_nationkey").cast("string").alias("domain"))
    mappings = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("textbook_id"), F.col("l_suppkey").alias("standard_code"), F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("reasoning"))
    items.write_star(textbooks, standards, mappings, path)
    t, s, m = (spark.read.parquet(f"{path}/star/{x}") for x in ("textbooks", "standards", "mappings"))
    flat = spark.read.csv(f"{path}/csv", header=True, schema="textbook_id long, subject string, full_path string, is_leaf boolean, standard_code long, description string, domain string, confidence double, reasoning string")
    by = lambda df, name: df.groupBy("subject").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")).select(F.lit(name).alias("part"), F.col("subject").alias("name"), "n", "confidence")
    none = F.lit(None).cast("double").alias("confidence")
    left = spark.read.schema("standard_code long, description string, domain string").json(f"{path}/unmapped").select(F.lit("unmapped").alias("part"), F.col("description").alias("name"), F.lit(1).cast("long").alias("n"), none)
    meta = spark.read.schema("name string, n long").json(f"{path}/meta").select(F.lit("meta").alias("part"), "name", "n", none)
    return by(m.join(t, "textbook_id").join(s, "standard_code"), "star").unionByName(by(flat, "csv")).unionByName(left).unionByName(meta)


@register("s12_partitioned_export", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "export")
    items.export_partitioned(table(spark, sf, "documents").select("doc_id", "lang", "source"), path, ["lang", "source"])
    return spark.read.parquet(path).groupBy("lang", "source").agg(F.count("*").alias("n"))


@register("s4_part_files", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as part files of JSON lists of at most 500, read back through the part reader."""
    path = scratch(spark, "parts")
    row = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), "event_type"))
    lists = table(spark, sf, "events").groupBy(F.expr("event_id div 500").alias("part")).agg(F.collect_list(row).alias("rows"))
    body = F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]"))
    bodies = F.when(F.col("part") % 2 == 0, body).otherwise(F.concat(F.lit('{"items":'), body, F.lit("}")))
    lists.select(bodies.alias("value")).write.text(path)
    back = items.lists_of(spark.read.text(path))
    return back.groupBy(F.get_json_object("item", "$.event_type").alias("event_type")).agg(F.count("*").alias("n"))
