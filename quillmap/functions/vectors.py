"""Vector functions as Column expressions over arrays of numbers; arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def square_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def norm(v: Column) -> Column:
    return F.sqrt(square_norm(v))


def divisor(v: Column) -> Column:
    """What divides a vector to length 1."""
    return F.greatest(norm(v), F.lit(EPSILON))


def unit(v: Column) -> Column:
    """At length 1; a zero vector stays zero."""
    return _scaled(v, divisor(v))


def _scaled(v: Column, by: Column) -> Column:
    # the divisor is computed once: it goes through a struct, not into the lambda
    pair = F.struct(v.alias("v"), by.alias("by"))
    return F.transform(F.array(pair), lambda p: F.transform(p["v"], lambda x: x / p["by"]))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPSILON))


def clamped_cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def is_unit(n: Column, tolerance: float) -> Column:
    return finite(n) & (F.abs(n - 1) <= tolerance)


def negative_components(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x < 0))


def vector_sum(v: Column, dimension: int) -> Column:
    """Sum over rows, component by component, as an array: plain sums, which Spark combines before it shuffles."""
    return F.array(*[F.sum(F.get(v, F.lit(k))) for k in range(dimension)])
