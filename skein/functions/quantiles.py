"""Exact quantiles of columns of any size, interpolated linearly between neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values up to which one task sorts all of a column; beyond it brackets are narrowed first.
SMALL = 1_000_000
#: Bins a bracket is cut into in each round.
BINS = 1024


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], small: int = SMALL) -> dict[str, float | None]:
    """name -> quantile of a numeric expression; nulls and NaNs are left out, None of no values.

    Of more than ``small`` values the bracket around the wanted ranks is narrowed by histograms,
    which are summed before the shuffle, until few distinct values are left in it.
    """
    if not wanted:
        return {}
    value = {n: F.when(~F.isnan(x.cast("double")), x.cast("double")) for n, (x, _) in wanted.items()}
    counts = df.agg(*[F.count(v).alias(n) for n, v in value.items()]).first()
    few = [n for n in wanted if counts[n] <= small]
    out: dict[str, float | None] = {}
    if few:
        row = df.agg(*[F.percentile(value[n], F.lit(wanted[n][1])).alias(n) for n in few]).first()
        out = {n: row[n] for n in few}
    for n in wanted:
        if n not in out:
            out[n] = _narrowed(df.select(value[n].alias("x")).filter("x is not null"), counts[n], wanted[n][1], small)
    return out


def _narrowed(x: DataFrame, n: int, q: float, small: int) -> float:
    rank = q * (n - 1)
    low, high = math.floor(rank), math.ceil(rank)
    edge = x.agg(F.min("x"), F.max("x")).first()
    a, b, below = edge[0], edge[1], 0
    while True:
        inside = x.filter((F.col("x") >= a) & (F.col("x") <= b))
        width = (b - a) / BINS
        if not 0 < width < math.inf or a + width == a:  # one value, or neighbours no bin can part
            break
        at = F.least(F.floor((F.col("x") - a) / width), F.lit(BINS - 1))
        bins = sorted(inside.groupBy(at.alias("at")).agg(F.count("*"), F.min("x"), F.max("x"), F.approx_count_distinct("x")).collect())
        first = last = None
        for k, (_, c, *_rest) in enumerate(bins):
            if first is None and below + c > low:
                first, start = k, below
            if below + c > high:
                last = k
                break
            below += c
        held = bins[first : last + 1]
        if (held[0][2], held[-1][3]) == (a, b):
            break
        a, b, below = held[0][2], held[-1][3], start
        if sum(h[4] for h in held) <= small // 2:
            break
    counts = x.filter((F.col("x") >= a) & (F.col("x") <= b)).groupBy("x").agg(F.count("*").alias("n")).orderBy("x")
    seen, at = below, {}
    for v, c in counts.toLocalIterator():
        for r in (low, high):
            if seen <= r < seen + c:
                at[r] = v
        seen += c
        if high in at:
            break
    return at[low] + (at[high] - at[low]) * (rank - low)
