"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 where either vector has no length."""
    length = norm(a) * norm(b)
    return F.when((norm(a) < 1e-12) | (norm(b) < 1e-12), F.lit(1.0)).otherwise(dot(a, b) / F.when(length > 0, length))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union), F.lit(0.0))


def is_subset(a: Column, b: Column) -> Column:
    """All elements of ``a`` are in ``b``; an empty array is in every one, and nothing but it in a null one."""
    return F.size(F.array_except(a, F.coalesce(b, F.slice(a, F.lit(1), F.lit(0))))) == 0
