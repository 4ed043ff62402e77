"""Vector arithmetic as column expressions (arrays of floats, summed in double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where a vector is null or the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    """``a`` over its norm; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def fused(a: Column, dim_a: int, b: Column, dim_b: int) -> Column:
    """Both vectors one after the other, a missing one as zeros, at unit length."""
    zeros = lambda d: F.array_repeat(F.lit(0.0), d)
    return unit(F.concat(F.coalesce(a.cast("array<double>"), zeros(dim_a)), F.coalesce(b.cast("array<double>"), zeros(dim_b))))
