"""Ranks within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", item: str = "item_id") -> DataFrame:
    """The k best rows of each group with their rank; ties go to the smaller item."""
    order = Window.partitionBy(by).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
