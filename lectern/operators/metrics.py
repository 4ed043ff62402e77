"""Ranking metrics of (query_id, item_id, rank) rows against (query_id, item_id, relevance) ground truth, or against one that is known by groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut

CUTS = (1, 3, 5, 10, 20)


@dataclass
class Grouped:
    """A ground truth that relates whole groups, without its pairs, whose number is the square of a group's size.

    ``wanted``: (query_id, n_rel, best) of the queries with relevant items, ``best`` the relevances of the first max(CUTS) of them in ideal order;
    ``judged`` gives (query_id, item_id, ...) rows that the truth holds their relevance and drops the others; ``ids``: (item_id) of all that the truth names.
    """

    wanted: DataFrame
    judged: Callable[[DataFrame], DataFrame]
    ids: DataFrame


def same_group(asked: DataFrame, members: DataFrame) -> Grouped:
    """The truth in which the members of a query's group, (group, item_id, relevance), are relevant to it, itself excluded; ``asked``: (query_id, group)."""
    n = max(CUTS)
    members = members.where("group IS NOT NULL").dropDuplicates(["group", "item_id"])
    asked = asked.where("group IS NOT NULL").distinct()
    order = Window.partitionBy("group").orderBy(F.desc("relevance"), "item_id")
    first = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n + 1)
    first = first.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("place", "item_id", "relevance"))).alias("first"))  # n + 1 at most
    own = members.select("group", F.col("item_id").alias("query_id"), F.lit(1).alias("own"))
    sizes = members.groupBy("group").agg(F.count("*").alias("n"))
    each = asked.join(own, ["group", "query_id"], "left").join(sizes, "group").join(first, "group")
    best = F.transform(F.slice(F.filter("first", lambda s: s["item_id"] != F.col("query_id")), 1, n), lambda s: s["relevance"])
    wanted = each.select("query_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n_rel"), best.alias("best")).where("n_rel > 0")

    def judged(rows: DataFrame) -> DataFrame:
        return rows.join(asked, "query_id").join(members, ["group", "item_id"]).where("query_id <> item_id").drop("group")

    held = members.join(asked.groupBy("group").agg(F.min("query_id").alias("low"), F.max("query_id").alias("high")), "group")
    # an item is named where some query of its group is another one
    ids = held.where("low <> item_id OR high <> item_id").select("item_id").union(wanted.select("query_id")).distinct()
    return Grouped(wanted, judged, ids)


def per_query(ranked: DataFrame, truth: DataFrame | Grouped, extra: tuple[str, ...] = (), cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """recall@k, hit@k, NDCG@k, reciprocal rank and average precision of each query.

    Queries without relevant items are left out; queries without results score 0. ``extra`` names columns of
    ``ranked`` (a model, a configuration) within which queries are kept apart.
    """
    if extra:
        ranked = cut(ranked.select(*extra, "query_id", "item_id", "rank"), "ranked")  # it is read twice below
    keys = [*extra, "query_id"]
    ranked = ranked.select(*keys, "item_id", "rank")
    if isinstance(truth, Grouped):
        gains = F.transform("best", lambda r, i: r / F.log2(i + 2))
        ideal = [F.when(F.size("best") > 0, F.aggregate(F.slice(gains, 1, k), F.lit(0.0), lambda s, x: s + x)).alias(f"ideal_{k}") for k in cuts]
        wanted, hits = truth.wanted.select("query_id", "n_rel", *ideal), truth.judged(ranked)
    else:
        truth = truth.dropDuplicates(["query_id", "item_id"])
        ideal_order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "item_id")
        ideal = truth.withColumn("place", F.row_number().over(ideal_order))
        gain = F.col("relevance") / F.log2(F.col("place") + 1)
        wanted = ideal.groupBy("query_id").agg(F.count("*").alias("n_rel"), *[F.sum(F.when(F.col("place") <= k, gain)).alias(f"ideal_{k}") for k in cuts])
        hits = ranked.join(truth, ["query_id", "item_id"])
    hits = hits.withColumn("seen", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))
    found = hits.groupBy(*keys).agg(
        F.min("rank").alias("first"),
        F.sum(F.col("seen") / F.col("rank")).alias("precision_sum"),
        *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"hits_{k}") for k in cuts],
        *[F.sum(F.when(F.col("rank") <= k, F.col("relevance") / F.log2(F.col("rank") + 1))).alias(f"gain_{k}") for k in cuts],
    )
    every = ranked.select(*extra).distinct().crossJoin(wanted) if extra else wanted
    both = every.join(found, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        *keys,
        *[F.round(zero(F.col(f"hits_{k}") / F.col("n_rel")), 6).alias(f"recall_{k}") for k in cuts],
        *[F.when(F.coalesce(F.col(f"hits_{k}"), F.lit(0)) > 0, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in cuts],
        *[F.round(F.when(F.col(f"ideal_{k}") > 0, zero(F.col(f"gain_{k}")) / F.col(f"ideal_{k}")).otherwise(0.0), 6).alias(f"ndcg_{k}") for k in cuts],
        F.round(zero(1.0 / F.col("first")), 6).alias("rr"),
        F.round(zero(F.col("precision_sum") / F.col("n_rel")), 6).alias("ap"),
    )


def averages(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of every metric, with the number of queries."""
    names = [c for c, t in metrics.dtypes if t == "double" and c not in by]
    return metrics.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def by_category(metrics: DataFrame, category: str) -> DataFrame:
    """Means overall (category 'all') and for each category."""
    names = [c for c, t in metrics.dtypes if t == "double"]
    both = metrics.groupingSets([[category], []], category)
    means = [F.round(F.avg(c), 6).alias(c) for c in names]
    return both.agg(F.grouping(category).alias("g"), F.count("*").alias("n_queries"), *means).select(F.when(F.col("g") == 1, "all").otherwise(F.col(category).cast("string")).alias(category), "n_queries", *names)
