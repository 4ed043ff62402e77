"""Scoring of candidate responses against declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.strings import compare_key


def normal(values: Column, fold_case: bool = True) -> Column:
    return F.transform(values, compare_key) if fold_case else F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))


def is_correct(value: Column, correct: Column, cardinality: Column, fold_case: bool = True) -> Column:
    """single: equal; multiple: equal as sets; ordered: equal in order. Null or no key is wrong."""
    v, c = normal(value, fold_case), normal(correct, fold_case)
    as_set = lambda a: F.array_sort(F.array_distinct(a))
    fits = F.when(cardinality == "ordered", v == c).when(cardinality == "multiple", as_set(v) == as_set(c)).otherwise((F.size(v) > 0) & (F.get(v, F.lit(0)) == F.get(c, F.lit(0))))
    return F.coalesce(fits & (F.size(c) > 0), F.lit(False))


def mapped(responses: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, correct): default + mapped values, clamped; correct from the upper bound on.

    ``responses``: keys, item_id, value array, lower, upper, default; ``entries``: item_id, key, mapped, case_sensitive.
    A null response scores 0.
    """
    each = responses.select(*keys, "item_id", "lower", "upper", "default", F.col("value").isNull().alias("none"), F.explode_outer("value").alias("v"))
    e = entries.alias("e")
    same = (F.col("r.item_id") == F.col("e.item_id")) & F.when(F.col("e.case_sensitive"), F.col("v") == F.col("e.key")).otherwise(F.lower("v") == F.lower("e.key"))
    got = each.alias("r").join(e, same, "left").groupBy(*[F.col(f"r.{k}") for k in keys], F.col("r.lower"), F.col("r.upper"), F.col("r.default"), F.col("r.none")).agg(F.coalesce(F.sum("e.mapped"), F.lit(0.0)).alias("points"))
    total = F.greatest(F.coalesce("lower", F.lit(float("-inf"))), F.least(F.coalesce("upper", F.lit(float("inf"))), F.col("default") + F.col("points")))
    score = F.when(F.col("none"), 0.0).otherwise(total)
    return got.select(*keys, F.round(score, 6).alias("score"), F.coalesce(score >= F.col("upper"), F.lit(False)).alias("correct"))


def rolled_up(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of an item: score, maximum, all or partly correct, details in order of the response id."""
    detail = F.struct("response_id", F.col("score").alias("score"))
    each = scored.groupBy(*keys).agg(F.round(F.sum("score"), 6).alias("score"), F.round(F.sum("max_score"), 6).alias("max_score"), F.bool_and("correct").alias("all_correct"), F.bool_or(F.col("score") > 0).alias("some"), F.array_sort(F.collect_list(detail)).alias("d"))
    details = F.array_join(F.transform("d", lambda s: F.concat_ws("=", s["response_id"].cast("string"), s["score"].cast("int").cast("string"))), ",")
    return each.select(*keys, "score", "max_score", "all_correct", (F.col("some") & ~F.col("all_correct")).alias("partly_correct"), F.when(F.col("all_correct"), "correct").when(F.col("some"), "partial").otherwise("incorrect").alias("feedback"), details.alias("details"))


def partial_credit(value: Column, correct: Column) -> Column:
    """Matched candidate values (repeats count) over the number of correct ones."""
    v, c = normal(value), normal(correct)
    hit = F.size(F.filter(v, lambda x: F.array_contains(c, x)))
    return F.when(F.size(c) > 0, hit / F.size(c)).otherwise(0.0)


def latest(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each key; a key whose last value is null is cleared."""
    last = events.groupBy(*keys).agg(F.max_by(F.struct(value), F.struct(*order)).alias("s"))
    return last.select(*keys, F.col(f"s.{value}").alias(value)).where(F.col(value).isNotNull())


def complete(state: DataFrame, sessions: DataFrame, declared: DataFrame, session: str = "session_id", response: str = "response_id") -> DataFrame:
    """Whether every declared response of each session is answered."""
    n = declared.select(response).distinct().agg(F.count("*").alias("n_declared"))
    answered = state.join(declared.select(response).distinct(), response, "left_semi").groupBy(session).agg(F.count("*").alias("n_answered"))
    return sessions.join(answered, session, "left").crossJoin(F.broadcast(n)).select(session, F.coalesce("n_answered", F.lit(0)).alias("n_answered"), (F.coalesce("n_answered", F.lit(0)) == F.col("n_declared")).alias("complete"))
