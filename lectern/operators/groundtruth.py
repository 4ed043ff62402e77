"""Ground-truth construction, rank analysis and hit assembly."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import metrics, search
from lectern.session import cut


def ranks_of(ranked: DataFrame, truth: DataFrame, missing: int = 999) -> DataFrame:
    """(query_id, item_id, rank) of every relevant item; ``missing`` where it wasn't retrieved."""
    found = ranked.select("query_id", "item_id", "rank")
    return truth.select("query_id", "item_id").join(found, ["query_id", "item_id"], "left").select("query_id", "item_id", F.coalesce("rank", F.lit(missing)).cast("long").alias("rank"))


def rank_buckets(ranks: DataFrame) -> DataFrame:
    r = F.col("rank")
    bucket = F.when(r <= 5, "1-5").when(r <= 10, "6-10").when(r <= 20, "11-20").otherwise("21+")
    return ranks.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count(F.when(r == 1, 1)).alias("n_first"))


def first_rank_regressions(base: DataFrame, other: DataFrame, n: int) -> DataFrame:
    """Queries whose first relevant rank falls most from ``base`` to ``other``."""
    a = base.groupBy("query_id").agg(F.min("rank").alias("first_all"))
    b = other.groupBy("query_id").agg(F.min("rank").alias("first_best"))
    return a.join(b, "query_id").withColumn("diff", F.col("first_best") - F.col("first_all")).orderBy(F.desc("diff"), "query_id").limit(n)


def graded(ranked: DataFrame) -> DataFrame:
    """The first five hits as ground truth: ranks 1-2 are 3, 3-4 are 2, 5 is 1."""
    grade = F.when(F.col("rank") <= 2, 3).when(F.col("rank") <= 4, 2).otherwise(1)
    return ranked.where("rank <= 5").select("query_id", "item_id", grade.alias("relevance"))


def verification(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Each query's hits in order, marked y or n by the ground truth."""
    known = truth.select("query_id", "item_id", F.lit("y").alias("known"))
    each = ranked.join(known, ["query_id", "item_id"], "left").select("query_id", "rank", F.concat_ws(":", F.col("item_id").cast("string"), F.coalesce("known", F.lit("n"))).alias("hit"))
    return each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "hit"))), lambda s: s["hit"]), " ").alias("hits"))


def unordered_pairs(ranked: DataFrame) -> DataFrame:
    """(a, b, score) with a < b, each pair once."""
    return ranked.groupBy(F.least("query_id", "item_id").alias("a"), F.greatest("query_id", "item_id").alias("b")).agg(F.max("score").alias("score"))


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of every edge, as (query_id, item_id)."""
    return edges.select(F.col(a).alias("query_id"), F.col(b).alias("item_id")).union(edges.select(b, a)).distinct()


def resolve_prefixes(short: DataFrame, full: DataFrame) -> DataFrame:
    """The smallest ``full`` value that starts with each ``short`` one, or itself.

    A prefix is the range of the sorted values from itself on, so the first full value at or after it is the only one to test. Both sides
    are sorted together by ranges, one row a value, a prefix before an equal full value: a task finds the next full value in its own range, and the
    first one of the ranges after it comes from a table of one row a range.
    """
    values = short.select(F.col("short").alias("v"), F.lit(0).alias("kind")).unionByName(full.where("full IS NOT NULL").select(F.col("full").alias("v"), F.lit(1).alias("kind")).distinct())
    dealt = cut(values.where("v IS NOT NULL").repartitionByRange("v", "kind").withColumn("range", F.spark_partition_id()), "ranges")
    upward = Window.partitionBy("range").orderBy(F.desc("v"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumn("next", F.last(F.when(F.col("kind") == 1, F.col("v")), ignorenulls=True).over(upward)).where("kind = 0")
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = dealt.groupBy("range").agg(F.min(F.when(F.col("kind") == 1, F.col("v"))).alias("low")).withColumn("after", F.last("low", ignorenulls=True).over(later))
    met = inside.join(starts.select("range", "after"), "range").withColumn("found", F.coalesce("next", "after"))
    return met.select(F.col("v").alias("short"), F.when(F.startswith("found", "v"), F.col("found")).otherwise(F.col("v")).alias("resolved")).distinct()


UNITS = {"unit_small": 0.4, "unit_medium": 0.3, "unit_large": 0.2, "difficulty": 0.1}
SIDE = 4_096  # items of a side of a task, about, so some 17 million pairs


def metadata_similarity(a: str, b: str) -> Column:
    """Similarity of two aliased rows: equal non-empty units and difficulty, weighted."""
    total = F.lit(0.0)
    for c, w in UNITS.items():
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        total = total + F.when((x == y) & (x != ""), w).otherwise(0.0)
    return total


def metadata_matrix(items: DataFrame, side: int = SIDE) -> DataFrame:
    """(x, y, score) of all pairs of items but an item with itself, in both directions; 0 where they have nothing in common.

    Items that agree in all units are packed into lists of about ``side`` at most, whatever the size of their class. Lists meet in a Cartesian product, a score
    for each two of them, and only what a task writes grows with the pairs: nothing of them is shuffled or held. A query's items come ascending, so files stay small.
    """
    units, parts = list(UNITS), max(1, math.ceil(items.count() / side))
    dealt = items.repartitionByRange(parts, *units, "item_id").withColumn("part", F.spark_partition_id())  # a large class takes several parts
    lists = cut(dealt.groupBy("part", *units).agg(F.sort_array(F.collect_list("item_id")).alias("ids")), "lists").repartition(parts)
    a, b = lists.alias("a"), lists.hint("shuffle_replicate_nl").alias("b")
    met = a.crossJoin(b).select(F.col("a.ids").alias("xs"), F.col("b.ids").alias("ys"), F.round(metadata_similarity("a", "b"), 6).alias("score"))
    pairs = met.select(F.explode("xs").alias("x"), "ys", "score").select("x", F.explode("ys").alias("y"), "score")
    return pairs.where("x <> y")


def metadata_pairs(items: DataFrame) -> DataFrame:
    """(kind, a, b, score) of all pairs with anything in common, by classes of items that agree in all units.

    A ``member`` row gives item a its class b (its smallest item); a ``pair`` row gives the score of each member of class a with each of class b, a <= b; a class of
    several items is a pair with itself. Classes meet where they share a unit, so items are never paired.
    """
    t = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in UNITS])
    each = items.select("item_id", t.alias("t"))
    classes = cut(each.groupBy("t").agg(F.min("item_id").alias("rep"), F.count("*").alias("n")), "classes")
    said = classes.select("rep", "n", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col("t")[u].alias("value"), F.lit(w).alias("w")) for u, w in UNITS.items()])).alias("s"))
    said = said.select("rep", "n", "s.unit", "s.value", "s.w").where("value <> ''")
    met = said.select("unit", "value", "w", "n", F.col("rep").alias("a")).join(said.select("unit", "value", F.col("rep").alias("b")), ["unit", "value"]).where("a < b OR (a = b AND n > 1)")
    pairs = met.groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("score"))
    members = each.join(classes, "t").select(F.lit("member").alias("kind"), F.col("item_id").alias("a"), F.col("rep").alias("b"), F.lit(None).cast("double").alias("score"))
    return members.unionByName(pairs.select(F.lit("pair").alias("kind"), "a", "b", "score"))


def metadata_nearest(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, item_id, score, rank): the k items most similar by metadata, of those with anything in common; ties go to the smaller id.

    Items and queries that agree in all units are one tuple. Tuples meet where they share a unit, never all with all; of the tuples that a query's
    tuple meets, only the best that hold k items are opened, and of each only its first k + 1 items.
    """
    units = list(UNITS)
    tuple_of = lambda df: df.withColumn("t", F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in units]))
    q, c = tuple_of(queries).select("query_id", "t"), tuple_of(items).select("item_id", "t")
    first = Window.partitionBy("t").orderBy("item_id")
    few = cut(c.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n"), "firsts")
    sizes = c.groupBy("t").agg(F.count("*").alias("n"))
    said = lambda t: F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(t)[u].alias("value"), F.lit(w).alias("w")) for u, w in UNITS.items()]))
    asked = q.select(F.col("t").alias("qt")).distinct().select("qt", said("qt").alias("s")).select("qt", "s.unit", "s.value", "s.w").where("value <> ''")
    held = sizes.select("t", "n", said("t").alias("s")).select("t", "n", "s.unit", "s.value").where("value <> ''")
    met = asked.join(held, ["unit", "value"]).groupBy("qt", "t").agg(F.round(F.sum("w"), 6).alias("score"), F.first("n").alias("n"))
    better = Window.partitionBy("qt").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy("qt", "score")
    opened = met.withColumn("before", F.sum("n").over(better) - F.sum("n").over(peers)).where(F.col("before") <= k)
    order = Window.partitionBy("qt").orderBy(F.desc("score"), "item_id")
    best_ = opened.join(few, "t").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    pairs = q.join(best_.select(F.col("qt").alias("t"), "item_id", "score"), "t").where("query_id <> item_id")
    return search.best(pairs.select("query_id", "item_id", "score"), k)


def auto_truth(pairs: DataFrame, least: float = 0.05, k: int = 5) -> DataFrame:
    """0.7 x text score + 0.3 x ``meta``, from ``least`` up, the best k of each query, graded by rank."""
    both = pairs.select("query_id", "item_id", F.round(0.7 * F.col("score") + 0.3 * F.col("meta"), 4).alias("score")).where(F.col("score") >= least)
    grade = F.when(F.col("rank") <= 2, 3).when(F.col("rank") <= 4, 2).otherwise(1)
    return search.best(both, k).select("query_id", "item_id", "score", grade.alias("relevance"))


def from_judgments(judged: DataFrame, least: int = 3, k: int = 5) -> DataFrame:
    """Judged pairs of relevance ``least`` or more, the first k of each query in the order judged."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    return judged.where(F.col("relevance_score") >= least).withColumn("place", place).where(F.col("place") <= k).select("query_id", "item_id", F.col("relevance_score").alias("relevance"))


def search_or_keyword(asked: DataFrame, corpus: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Vector hits of queries that have a vector; of those that have only words, the first k items by id that hold one of them (score 0.8).

    A query is a row for each of its words. Of each word the first k items are enough, as no later one can be among the query's first k.
    """
    vectors = asked.where("embedding IS NOT NULL").select("query_id", "embedding").dropDuplicates(["query_id"])
    hits = search.knn(vectors, corpus, k).select("query_id", "item_id", "score", F.lit("vector").alias("path"))
    words = asked.where("embedding IS NULL AND word IS NOT NULL").select("query_id", "word").distinct()
    found = search.keywords(items, words, k).join(words, "word").select("query_id", "item_id").distinct()
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("item_id"))).where(F.col("n") <= k)
    return hits.unionByName(first.select("query_id", "item_id", F.lit(0.8).alias("score"), F.lit("keyword").alias("path")))


def batch(asked: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row a query: its items in order, empty if it has none."""
    lists = ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda s: s["item_id"].cast("string")), ",").alias("items"))
    return asked.join(lists, "query_id", "left").select("query_id", F.coalesce("items", F.lit("")).alias("items"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of both ground truths, with the relevance of ``b``."""
    return b.join(a.select("query_id", "item_id").distinct(), ["query_id", "item_id"])


def statistics(truth: DataFrame) -> DataFrame:
    per = truth.groupBy("query_id").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("relevance") == g, 1)).alias(f"g{g}") for g in (1, 2, 3)])
    return per.agg(F.count("*").alias("queries"), F.sum("n").alias("pairs"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"), *[F.sum(f"g{g}").alias(f"grade_{g}") for g in (1, 2, 3)])


def restrict(items: DataFrame, truth: DataFrame) -> DataFrame:
    """Items that occur in the ground truth, as query or as relevant item."""
    ids = truth.select(F.col("query_id").alias("item_id")).union(truth.select("item_id")).distinct()
    return items.join(ids, "item_id", "left_semi")


def compared_models(models: dict[str, tuple[DataFrame, DataFrame]], truths: dict[str, DataFrame | metrics.Grouped], k: int = 20) -> DataFrame:
    """(truth, model, n_items, n_queries, metrics in percent): each model, a pair of queries and corpus, against each ground truth.

    For a fair comparison a model only searches the items that the truth names, as query or as relevant item.
    """
    out = []
    for truth_name, rows in truths.items():
        if isinstance(rows, metrics.Grouped):
            ids = cut(rows.ids, "ids")
        else:
            rows = cut(rows.select("query_id", "item_id", "relevance"), "truth")
            ids = cut(rows.select(F.col("query_id").alias("item_id")).union(rows.select("item_id")).distinct(), "ids")
        ranked = [search.knn(q.join(ids.withColumnRenamed("item_id", "query_id"), "query_id", "left_semi"), c.join(ids, "item_id", "left_semi"), k).withColumn("model", F.lit(name)) for name, (q, c) in models.items()]
        each = metrics.per_query(reduce(DataFrame.unionByName, ranked), rows, ("model",))
        names = [c for c, t in each.dtypes if t == "double"]
        means = each.groupBy("model").agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c) * 100, 1).alias(c) for c in names])
        out.append(means.select(F.lit(truth_name).alias("truth"), "model", F.lit(ids.count()).cast("long").alias("n_items"), "n_queries", *names))
    return reduce(DataFrame.unionByName, out)


def best_of(scored: DataFrame, key: str, metric: str) -> DataFrame:
    """The row with the highest metric; ties go to the smaller key."""
    return scored.orderBy(F.desc(metric), key).limit(1)


def deltas(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    return baseline.withColumnRenamed("value", "baseline").join(variant.withColumnRenamed("value", "variant"), "metric").withColumn("delta", F.round(F.col("variant") - F.col("baseline"), 6))
