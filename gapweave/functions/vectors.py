"""Column builders for vectors as ARRAY<DOUBLE>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once, also where a lambda in the body names it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for missing, empty, unequal or zero vectors and for NaN or infinite results."""
    same = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    sound = lambda value: F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value).otherwise(F.lit(0.0))
    return F.when(same, let(F.try_divide(dot(a, b), norm(a) * norm(b)), sound)).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length 1, or null where it has none."""
    return let(norm(a), lambda length: F.when(length > 0, F.transform(a, lambda x: x / length)))


def mean_of(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors of one size; null for none."""
    return F.when(F.size(vectors) > 0, F.transform(sum_of(vectors), lambda x: x / F.size(vectors)))


def sum_of(vectors: Column) -> Column:
    """Element-wise sum of an array of vectors, as long as the longest; null for none."""
    rest = F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(vectors, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
