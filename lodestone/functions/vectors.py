"""Vector functions as Column expressions over arrays, and as matrix UDFs for many rows at once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def is_nonzero(a: Column) -> Column:
    return F.exists(a, lambda x: x != 0)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), n)


def or_zeros(a: Column, n: int) -> Column:
    return F.coalesce(a, zeros(n))
