"""Vectors as array columns; sums are taken in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, even where f uses it once an element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def distance(a: Column, b: Column) -> Column:
    """Euclidean (FN25)."""
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def norm(a: Column, p: int = 2) -> Column:
    a = doubles(a)
    return _sum(F.transform(a, F.abs)) if p == 1 else F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def normalised(a: Column, p: int = 2) -> Column:
    """FN24; a zero vector stays as it is."""
    return _once(doubles(a), lambda x: _once(norm(x, p), lambda n: F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(x)))


def softmax(a: Column) -> Column:
    e = _once(doubles(a), lambda x: _once(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    return _once(e, lambda x: _once(_sum(x), lambda total: F.transform(x, lambda v: v / total)))


def margin(probabilities: Column) -> Column:
    """TK06: one plus the second largest minus the largest; largest for the least certain."""
    p = F.sort_array(probabilities, asc=False)
    return 1 + F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(0.0)) - F.element_at(p, 1)


def chi_square(a: Column, b: Column) -> Column:
    """FN23: half the sum of squared differences over sums; places where both are 0 count nothing."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.when(x + y != 0, (x - y) * (x - y) / (x + y)).otherwise(0.0))) / 2


def kernel(d: Column, scale: float = 10.0) -> Column:
    return F.exp(-d / scale)


def gaussian_weight(d: Column, scale: float = 5.0) -> Column:
    """FN27: the normal density at d over that at 0."""
    return F.exp(-d * d / F.lit(2 * scale * scale))


def concat(*vectors: Column) -> Column:
    """FN08: null vectors are left out; null only if all are."""
    empty = lambda v: F.coalesce(doubles(v), F.array().cast("array<double>"))
    return F.when(F.coalesce(*vectors).isNotNull(), F.concat(*map(empty, vectors)))


def elementwise_max(vectors: Column) -> Column:
    """Largest value of each place over an array of vectors."""
    return F.aggregate(F.slice(vectors, F.lit(2), F.greatest(F.lit(0), F.size(vectors) - 1)), F.element_at(vectors, 1), lambda a, v: F.zip_with(a, v, lambda x, y: F.greatest(x, y)))
