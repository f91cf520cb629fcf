"""Vector functions over arrays of numbers, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, and not anew for every element of an array."""
    return F.transform(F.array(value), use)[0]


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is. Scaled by its largest component first, so nothing overflows."""
    top = F.array_max(F.transform(doubles(v), F.abs))
    with_top = lambda t: once(norm(F.transform(doubles(v), lambda y: y / t)), lambda n: F.transform(doubles(v), lambda x: x / t / n))
    return F.when(top > 0, once(top, with_top)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
