"""Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector scaled to length 1; vectors of no length stay as they are."""
    n = norm(v)
    return F.when(n > 1e-12, F.transform(v, lambda x: x / n)).otherwise(v)


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
