"""Column expressions over whole series (arrays of doubles in window order)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.vectors import clip, finite


def let(x: Column, body) -> Column:
    """``body(x)`` with ``x`` worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def kept(s: Column) -> Column:
    """The finite values of a series."""
    return F.filter(s, finite)


def total(s: Column) -> Column:
    return F.aggregate(s, F.lit(0.0), lambda a, x: a + x)


def mean(s: Column) -> Column:
    """Mean of a series; NaN of an empty one."""
    return let(s, lambda y: F.when(F.size(y) > 0, total(y) / F.size(y)).otherwise(F.lit(float("nan"))))


def tail(s: Column, n: int) -> Column:
    return let(s, lambda y: F.slice(y, F.greatest(F.lit(1), F.size(y) - n + 1), n))


def std(s: Column) -> Column:
    """Population standard deviation; NaN of an empty series."""

    def around(y: Column) -> Column:
        square = lambda m: F.aggregate(y, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
        return F.when(F.size(y) > 0, F.sqrt(let(mean(y), square) / F.size(y))).otherwise(F.lit(float("nan")))

    return let(s, around)


def head_tail_delta(s: Column) -> Column:
    """Mean of the last three finite values less the mean of the first third of them."""

    def delta(f: Column) -> Column:
        head = F.slice(f, 1, F.greatest(F.lit(1), F.floor(F.size(f) / 3).cast("int")))
        return F.when(F.size(f) > 0, mean(tail(f, 3)) - mean(head)).otherwise(F.lit(float("nan")))

    return let(kept(s), delta)


def late_mean(s: Column, n: int = 3) -> Column:
    return mean(tail(s, n))


def dip_recover(s: Column) -> Column:
    """How far a series leaves its start and comes back: an interior minimum at least 0.04 below."""

    def shape(y: Column, low: Column) -> Column:
        at, drop = F.array_position(y, low), F.get(y, F.lit(0)) - low
        score = clip((F.element_at(y, -1) - low) / drop * clip(drop / 0.12, 0.0, 1.0), 0.0, 1.0)
        ok = (F.size(y) >= 4) & (drop >= 0.04) & (at > 1) & (at < F.size(y))
        return F.when(ok, score).otherwise(F.lit(0.0))

    return let(kept(s), lambda y: let(F.array_min(y), lambda low: shape(y, low)))


def rise_fall(s: Column) -> Column:
    """How far an interior peak of at least 0.12 stands above the ends."""

    def shape(y: Column, top: Column) -> Column:
        at = F.array_position(y, top)
        ok = (F.size(y) >= 4) & (top >= 0.12) & (at > 1) & (at < F.size(y))
        ends = (F.element_at(y, 1) + F.element_at(y, -1)) / 2
        return F.when(ok, clip((top - ends) / top, 0.0, 1.0)).otherwise(F.lit(0.0))

    return let(kept(s), lambda y: let(F.array_max(y), lambda top: shape(y, top)))


def step_shape(s: Column) -> Column:
    """Share of the largest jump in all change, times the flatness of what follows it."""

    def shape(y: Column, jumps: Column, top: Column) -> Column:
        def flat(rest: Column) -> Column:
            return F.when(F.size(rest) <= 1, F.lit(1.0)).otherwise(F.exp(-std(rest) / (top + 1e-9)))

        after = F.slice(y, F.array_position(jumps, top).cast("int") + 1, F.size(y))
        share = let(total(jumps), lambda change: F.when(change > 1e-12, top / change).otherwise(F.lit(0.0)))
        return F.when(F.size(y) >= 4, clip(share * let(after, flat), 0.0, 1.0)).otherwise(F.lit(0.0))

    def jumps_of(y: Column) -> Column:
        later, n = F.slice(y, 2, F.size(y)), F.greatest(F.lit(0), F.size(y) - 1)
        return F.zip_with(later, F.slice(y, 1, n), lambda a, b: F.abs(a - b))

    return let(kept(s), lambda y: let(jumps_of(y), lambda j: let(F.array_max(j), lambda top: shape(y, j, top))))


def resample(s: Column, grid: int = 20) -> Column:
    """The series read at ``grid`` even steps of its progress, linearly; NaNs below two finite values."""
    steps = F.sequence(F.lit(0), F.lit(grid - 1))

    def read(y: Column) -> Column:
        last = F.size(y) - 1

        def at(p: Column) -> Column:
            low = F.floor(p).cast("int")
            a = F.get(y, low)
            return a + (F.get(y, F.least(low + 1, last)) - a) * (p - low)

        points = F.transform(steps, lambda k: let(k / float(grid - 1) * last, at))
        return F.when(F.size(y) >= 2, points).otherwise(F.transform(steps, lambda _: F.lit(float("nan"))))

    return let(kept(s), read)
