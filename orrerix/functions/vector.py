"""Vector expressions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """A vector of length 1; null for the zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def distance(similarity: Column) -> Column:
    return F.lit(1.0) - similarity


def tanimoto_sets(a: Column, b: Column) -> Column:
    """Of two arrays of set bits; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def tanimoto_words(a: Column, b: Column) -> Column:
    """Of two arrays of 64-bit words."""
    ones = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0), lambda s, x: s + F.bit_count(x))
    union = ones(lambda x, y: x.bitwiseOR(y))
    return F.when(union > 0, ones(lambda x, y: x.bitwiseAND(y)) / union).otherwise(0.0)


def clipped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
