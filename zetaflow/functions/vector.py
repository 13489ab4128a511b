"""Distances of float vectors; the longer one is cut to the length of the shorter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zip(a: Column, b: Column, f) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: f(x.cast("double"), y.cast("double")))


def _sum(xs: Column) -> Column:
    return F.reduce(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _sum(_zip(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(l2(a, b))


def l1(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_max(_zip(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0))


def neg_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; 0 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1.0 - dot(a, b) / n).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    # the norm is bound by a lambda of its own: one that stands inside the other is added up anew for every component
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def of_units(a: Column, b: Column) -> Column:
    """1 - inner product, of vectors that are normalised already."""
    return 1.0 - dot(a, b)


def unit_cosine(a: Column, b: Column) -> Column:
    """1 - inner product of unit vectors; 1 if either is zero."""
    return of_units(unit(a), unit(b))


def hamming(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.size(F.filter(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x != y), lambda z: z))


METRICS = {"l2": l2, "euclidean": euclidean, "l1": l1, "chebyshev": chebyshev, "neg_dot": neg_dot, "cosine": cosine, "unit_cosine": unit_cosine, "hamming": hamming}
