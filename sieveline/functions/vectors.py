"""Vector and score expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def doubles(name: str) -> Column:
    return F.col(name).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a norm is 0; an error if the lengths differ or a number isn't finite."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    bad = (F.size(a) != F.size(b)) | ~finite(a) | ~finite(b)
    value = F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
    return F.when(bad, F.raise_error(F.lit("EVAL_INVALID_METRIC_INPUT: vectors must be finite and of one length"))).otherwise(value)


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def valid(a: Column, dim: int) -> Column:
    """Whether an array has dim finite numbers."""
    return F.coalesce((F.size(a) == dim) & finite(a), F.lit(False))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))
