"""Upserts, anti-joins, hierarchies, reconciliation, statistics and sampling over DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Last writer wins: the row with the highest ``order`` of each key; incoming rows beat existing ones of equal order."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First writer wins: existing rows, and of the incoming ones with new keys the first by ``order``."""
    first = Window.partitionBy(*keys).orderBy(order)
    new = incoming.join(existing.select(*keys), keys, "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return existing.unionByName(new)


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame, guard: Column) -> dict[str, DataFrame]:
    """Each table without the rows of the guarded ids. ``ids`` has one column, id."""
    gone = ids.where(guard).select("id").distinct()
    return {name: df.join(gone, df[key] == gone["id"], "left_anti") for name, (df, key) in tables.items()}


def split_by_dimension(vectors: DataFrame, dims: list[int]) -> tuple[DataFrame, DataFrame]:
    """Vectors of an allowed length, and the rejected others."""
    ok = F.coalesce(F.size("embedding").isin(*dims), F.lit(False))
    return vectors.where(ok), vectors.where(~ok)


def hydrate(hits: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Hits with their item's columns; a hit without an item stays, with nulls."""
    return hits.join(items, key, "left")


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done.select(key).distinct(), key, "left_anti")


def merged_hits(first: DataFrame, then: DataFrame, k: int, key: str = "item_id") -> DataFrame:
    """All of ``first`` in order, then those of ``then`` that aren't among them; ``rank`` renumbered, k at most."""
    offset = first.select(key, F.lit(0).alias("part"), "rank").unionByName(then.join(first.select(key), key, "left_anti").select(key, F.lit(1).alias("part"), "rank"))
    top = offset.orderBy("part", "rank", key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("part", "rank", key))).select(key, "rank")  # k rows


def leaves(paths: DataFrame, key: str, path: str) -> DataFrame:
    """(key, path, is_leaf): a row is a leaf if no longer path starts with its own. Prefixes are exploded, not compared in pairs."""
    shorter = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda n: F.slice(path, 1, n))
    longer = paths.where(F.size(path) > 1).select(F.explode(shorter).alias(path)).distinct()
    return paths.join(longer.withColumn("_inner", F.lit(True)), path, "left").select(key, path, F.col("_inner").isNull().alias("is_leaf"))


def reconcile(refs: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, verified, missing): sorted names of the references that exist as files, and of those that don't."""
    found = refs.join(files.select(F.col("name"), F.lit(True).alias("_there")).distinct(), "name", "left")
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("name"))))
    return found.groupBy(key).agg(pick(F.col("_there").isNotNull()).alias("verified"), pick(F.col("_there").isNull()).alias("missing"))


def grid(rows: DataFrame, a: str, a_values: list, b: str, b_values: list) -> DataFrame:
    """Counts of every combination of the target values, zeros included. Both lists are parameters, so the grid is small."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(x, y) for x in a_values for y in b_values], f"{a} {dict(rows.dtypes)[a]}, {b} {dict(rows.dtypes)[b]}")
    return cells.join(rows.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").na.fill(0, ["n"])


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of every value of ``columns`` in one pass."""
    sets = [[F.col(c)] for c in columns]
    out = rows.groupingSets(sets, *columns).agg(F.count("*").alias("n"), F.grouping_id(*columns).alias("g"))
    width = len(columns)
    field = reduce(lambda acc, ic: acc.when(F.col("g") == (1 << width) - 1 - (1 << (width - 1 - ic[0])), ic[1]), enumerate(columns), F.when(F.lit(False), ""))
    return out.select(field.alias("field"), F.coalesce(*[F.col(c).cast("string") for c in columns]).alias("value"), "n")


def duplicates(rows: DataFrame, key: Column, position: str, shown: int = 5) -> DataFrame:
    """(key, n, positions) of keys seen more than once, with their first positions."""
    keyed = rows.select(key.alias("key"), F.col(position).alias("pos"))
    first = Window.partitionBy("key").orderBy("pos")
    each = keyed.withColumn("r", F.row_number().over(first)).where(F.col("r") <= shown)
    n = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return n.join(each.groupBy("key").agg(F.array_sort(F.collect_list("pos")).alias("positions")), "key")


def rolled_cross_tab(rows: DataFrame, a: str, b: str, flag: Column) -> DataFrame:
    """Counts by (a, b) with subtotals ('*') and the grand total: n, n_flagged, percentage flagged, share of all."""
    g = rows.rollup(a, b).agg(F.count("*").alias("n"), F.count(F.when(flag, 1)).alias("n_flagged"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    total = rows.agg(F.count("*").alias("total"))
    name = lambda g_, c: F.when(F.col(g_) == 1, "*").otherwise(F.col(c))
    return g.crossJoin(F.broadcast(total)).select(name("ga", a).alias(a), name("gb", b).alias(b), "n", "n_flagged", F.round(F.col("n_flagged") / F.col("n") * 100, 6).alias("percent"), F.round(F.col("n") / F.col("total") * 100, 6).alias("share"))


def running(rows: DataFrame, by: list[str], order: list[str], weight: Column) -> DataFrame:
    """``rows`` plus _upto, the sum of ``weight`` over the rows of its group up to each row.

    Rows are dealt by ranges of (group, order) and written, so a large group is summed by several tasks: each sums its own
    rows and adds the group's sums of the ranges before. Rows of equal (group, order) are together.
    """
    dealt = cut(rows.withColumn("_w", weight).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by, "_range").agg(F.sum("_w").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.sum("_w").over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_inside", inside).join(starts, [*by, "_range"])
    return out.select(*rows.columns, (F.col("_start") + F.col("_inside")).alias("_upto"))


def percentiles(rows: DataFrame, value: str, by: list[str], points: dict[str, float]) -> DataFrame:
    """Exact percentiles (linear between neighbours) of each group, as columns named by ``points``.

    Equal values are counted first; the running count over a group's distinct values finds the places.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running(counts, by, ["_v"], F.col("_n")).join(counts.groupBy(*by).agg(F.sum("_n").alias("_total")), by)
    out = []
    for name, q in points.items():
        at = (F.col("_total") - 1) * q
        # the value at a place, counted from 0, is the first one whose running count is above it
        low, high = (F.min(F.when(F.col("_upto") > k, F.col("_v"))) for k in (F.floor(at), F.ceil(at)))
        out.append(F.round(low + (high - low) * F.max(at - F.floor(at)), 6).alias(name))
    return placed.groupBy(*by).agg(*out)


def latency_profile(events: DataFrame, value: str, by: list[str], success: Column) -> DataFrame:
    """Count, mean, population deviation, exact percentiles (linear), extremes and success rate."""
    plain = events.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"),
        F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(success.cast("double")), 6).alias("success_rate"),
    )
    return plain.join(percentiles(events, value, by, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), by, "left")


def quantile_sketches(events: DataFrame, value: str, by: list[str], k: int = 400) -> DataFrame:
    """(by, n, sketch): a KLL sketch of the values of each group, of bounded size, to be stored and merged later. With ``k`` of 400 ranks are within about 0.7 %."""
    some = events.where(F.col(value).isNotNull())
    return some.groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_profile(sketches: DataFrame, by: list[str], points: dict[str, float], k: int = 400) -> DataFrame:
    """(by, n, points): quantiles of stored sketches, merged over whatever else they were kept apart by. The events aren't read again."""
    all_ = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return all_.select(*by, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in points.items()])


def evidence(rows: DataFrame, by: list[str], order: list[str], shown: Column, n: int, name: str) -> DataFrame:
    """(by, name): the texts of the first n rows of each group, in order, as one text; n bounds what is brought together."""
    placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_n", shown.alias("s"))))
    return placed.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["s"]), "|").alias(name))


def counters(rows: DataFrame, fields: dict[str, Column], errors: Column, file: Column, shown: int = 100) -> DataFrame:
    """(field, value, n, files) of a run over files: good rows by each field ('unknown' if blank), errors by their first 50 characters
    with the first ``shown`` files, and totals. ``errors`` is an array, empty for a good row."""
    told = rows.select(errors.alias("errors"), file.alias("file"), *[F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown")).alias(name) for name, c in fields.items()])
    good = told.where(F.size("errors") == 0)
    counts = value_counts(good, list(fields)).withColumn("files", F.lit(""))
    bad = told.where(F.size("errors") > 0).select("file", F.explode("errors").alias("e")).select("file", F.substring("e", 1, 50).alias("value"))
    first = evidence(bad.distinct(), ["value"], ["file"], F.col("file").cast("string"), shown, "files")
    kinds = bad.groupBy("value").agg(F.count("*").alias("n")).join(first, "value").select(F.lit("error").alias("field"), "value", "n", "files")
    total = told.agg(F.count("*").alias("scanned"), F.count_if(F.size("errors") == 0).alias("good"), F.count_if(F.size("errors") > 0).alias("bad"))
    totals = total.select(F.inline(F.array(*[F.struct(F.lit("total").alias("field"), F.lit(c).alias("value"), F.col(c).alias("n"), F.lit("").alias("files")) for c in ("scanned", "good", "bad")])))
    return counts.unionByName(kinds).unionByName(totals)


def stratified(rows: DataFrame, strata: list[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """Exactly min(size, k) rows of each stratum, the same for the same seed."""
    order = Window.partitionBy(*strata).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def quota(rows: DataFrame, category: str, difficulty: str, quotas: dict[str, int], key: str, seed: int = 42) -> DataFrame:
    """Category quotas; inside, an equal share for each difficulty (at least 1), topped up from the rest.

    No difficulty gives more rows than the largest quota, so tasks keep only that many of each before any row is shuffled.
    """
    q = reduce(lambda c, kv: c.when(F.col(category) == kv[0], kv[1]), quotas.items(), F.when(F.lit(False), 0))
    h = F.xxhash64(key, F.lit(seed))
    rows = rows.withColumn("_quota", q).where("_quota IS NOT NULL")
    n = rows.groupBy(category).agg(F.countDistinct(difficulty).alias("_levels"))
    share = F.greatest(F.lit(1), F.floor(F.col("_quota") / F.col("_levels")))
    most = max([1, *quotas.values()])
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(category, difficulty).orderBy(h, key))).where(F.col("_r") <= most)
    inside = first.join(n, category).withColumn("_in", F.col("_r") <= share)
    order = Window.partitionBy(category).orderBy(F.desc("_in"), h, key)
    return inside.withColumn("_n", F.row_number().over(order)).where((F.col("_n") <= F.col("_quota")) & (F.col("_n") <= most)).drop("_quota", "_levels", "_in", "_n", "_r")


def first_n(rows: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The first n rows of each group: bounded evidence lists."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def numbered(rows: DataFrame, by: str, order: list[str], prefix: str) -> DataFrame:
    """Sequential ids inside each group: prefix_group_001 ..."""
    placed = running(rows, [by], order, F.lit(1))
    return placed.select(*rows.columns, F.format_string(f"{prefix}_%s_%03d", F.col(by), F.col("_upto").cast("long")).alias("id"))


def distinct_by(rows: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """One row a key: its first value and all its values, by ``order``."""
    return rows.groupBy(key.alias("key")).agg(F.min_by(value, order).alias("first"), F.array_sort(F.collect_set(value)).alias("variants"))
