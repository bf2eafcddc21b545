"""Statistics over tables of counts and over vectors."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.vectors import dot, unit
from skein.operators.ordering import positions
from skein.session import cut


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """p of a two-by-two table: the tables as likely as this one or less."""
    n, row, col = a + b + c + d, a + b, a + c

    def log_p(x: int) -> float:
        parts = (row, n - row, col, n - col), (n, x, row - x, col - x, n - row - col + x)
        return sum(math.lgamma(v + 1) for v in parts[0]) - sum(math.lgamma(v + 1) for v in parts[1])

    own, total = log_p(a), 0.0
    for x in range(max(0, row + col - n), min(row, col) + 1):
        p = log_p(x)
        if p <= own + 1e-7:
            total += math.exp(p)
    return min(1.0, total)


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, x)) for x in zip(a, b, c, d)])


def fisher_cells(rows: DataFrame, r: str, c: str) -> DataFrame:
    """Each cell of the table r x c against the rest: count, odds ratio, two-sided p."""
    t = rows.groupBy(r, c).agg(F.count("*").alias("a"))
    tr = t.groupBy(r).agg(F.sum("a").alias("rt"))
    tc = t.groupBy(c).agg(F.sum("a").alias("ct"))
    n = t.agg(F.sum("a").alias("n"))  # one row
    x = t.join(tr, r).join(tc, c).join(F.broadcast(n))
    b, cc = F.col("rt") - F.col("a"), F.col("ct") - F.col("a")
    d = F.col("n") - F.col("rt") - F.col("ct") + F.col("a")
    odds = F.when(b * cc > 0, F.col("a") * d / (b * cc)).otherwise(F.lit(float("inf")))
    return x.select(r, c, "a", odds.alias("odds_ratio"), fisher_p("a", b, cc, d).alias("p"))


def anisotropy(rows: DataFrame) -> DataFrame:
    """One row: mean cosine of all pairs of different vectors and of pairs of one thread.

    From the length of the sum of unit vectors, so no pairs are drawn or formed.
    """
    v = rows.filter("e is not null").withColumn("__v", array_to_vector("e"))
    sums = v.groupBy("thread_id").agg(vector_to_array(Summarizer.sum(F.col("__v"))).alias("s"), F.count("*").alias("n"))
    own = sums.select("n", dot(F.col("s"), F.col("s")).alias("q")).agg(F.try_divide(F.sum(F.col("q") - F.col("n")), F.sum(F.col("n") * (F.col("n") - 1))).alias("within"))
    every = v.agg(vector_to_array(Summarizer.sum(F.col("__v"))).alias("s"), F.count("*").alias("n"))
    every = every.filter("n > 1").select(((dot(F.col("s"), F.col("s")) - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("overall"))
    verdict = F.when(F.col("overall") > 0.3, "strong").when(F.col("overall") > 0.1, "mild").otherwise("none")
    return every.join(F.broadcast(own)).withColumn("anisotropy", verdict)  # one row each


def cosine_quantiles(rows: DataFrame, key: str, pairs: int = 20, seed: int = 42) -> DataFrame:
    """kind, n, mean, p05 to p95, over_03: cosines of drawn pairs of one thread and of different threads.

    Each vector meets the ones that follow it, up to ``pairs`` places on, in an order fixed by the
    seed, over all vectors and within each thread: a draw of pairs without replacement that needs no
    cross join. rows: thread_id, key, e.
    """
    mixed = rows.filter("e is not null").select("thread_id", "e", F.xxhash64(F.lit(seed), F.col(key)).alias("__h"), F.col(key).cast("string").alias("__k"))

    def draw(group: str, label: str, same: bool) -> DataFrame:
        at = positions(mixed.withColumn("__all", F.lit(0)), group, [F.col("__h"), F.col("__k")], "__p")
        left = at.select(group, F.col("thread_id").alias("t1"), F.col("e").alias("e1"), F.explode(F.sequence(F.col("__p") + 1, F.col("__p") + pairs)).alias("__p"))
        pair = left.join(at.select(group, "__p", F.col("thread_id").alias("t2"), "e"), [group, "__p"])
        pair = pair.filter(F.col("t1").eqNullSafe(F.col("t2")) if same else ~F.col("t1").eqNullSafe(F.col("t2")))
        return pair.select(F.lit(label).alias("kind"), dot(F.col("e1"), F.col("e")).alias("c"))

    c = draw("__all", "cross", False).unionByName(draw("thread_id", "within", True))
    cells = c.groupBy("kind", F.round("c", 6).alias("c")).agg(F.count("*").alias("n"))
    q = [F.percentile("c", F.lit(p), F.col("n")).alias(f"p{round(100 * p):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)]
    n = F.sum("n")
    return cells.groupBy("kind").agg(n.alias("n"), (F.sum(F.col("c") * F.col("n")) / n).alias("mean"), *q, (F.sum(F.when(F.col("c") > 0.3, F.col("n")).otherwise(0)) / n).alias("over_03"))


def exemplars(rows: DataFrame, group: str, key: str, n: int = 3) -> DataFrame:
    """group, key, cos, rank: the rows nearest to the unit mean of their group; ties by key."""
    v = rows.filter("e is not null").withColumn("__v", array_to_vector("e"))
    mean = v.groupBy(group).agg(vector_to_array(Summarizer.mean(F.col("__v"))).alias("m"))
    near = rows.join(mean, group).select(group, key, dot(F.col("e"), unit(F.col("m"))).alias("cos"))
    w = Window.partitionBy(group).orderBy(F.desc("cos"), F.col(key))  # each task keeps n a group before the shuffle
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: the chance of more than 2x under chi2 with 2a degrees."""
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # the series of the lower part
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - lead * total
    b = x + 1 - a  # the continued fraction of the upper part
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, 100_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def _totals(rows: DataFrame, r: str, c: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    t = rows.filter(F.col(r).isNotNull() & F.col(c).isNotNull()).groupBy(r, c).agg(F.count("*").alias("o"))
    t = cut(t, "cells")
    return t, t.groupBy(r).agg(F.sum("o").alias("rt")), t.groupBy(c).agg(F.sum("o").alias("ct")), t.agg(F.sum("o").alias("n"))


def independence(rows: DataFrame, r: str, c: str, least: int = 8) -> DataFrame:
    """chi2, dof, p, cramers_v, n, verdict: test of independence of two columns without correction.

    Only rows and columns that occur count; null values are left out. With fewer than two rows or
    columns, or fewer than ``least`` observations, the figures are null and verdict is too_sparse.
    """
    t, tr, tc, n = _totals(rows, r, c)
    # cells without observations add their expected count, so that the sum over the others is enough
    part = t.join(tr, r).join(tc, c).agg(F.sum(F.col("o") * F.col("o") / (F.col("rt").cast("double") * F.col("ct"))).alias("k"))
    shape = tr.agg(F.count("*").alias("nr")).join(tc.agg(F.count("*").alias("nc"))).join(part).join(n)  # one row each
    ok = (F.col("nr") >= 2) & (F.col("nc") >= 2) & (F.col("n") >= least)
    chi2 = F.when(ok, F.greatest(F.lit(0.0), F.col("n") * (F.col("k") - 1)))
    dof = F.when(ok, (F.col("nr") - 1) * (F.col("nc") - 1))
    v = F.sqrt(chi2 / (F.col("n") * (F.least("nr", "nc") - 1)))
    return shape.select(chi2.alias("chi2"), dof.alias("dof"), chi2_p(chi2, dof).alias("p"), v.alias("cramers_v"), F.coalesce("n", F.lit(0)).alias("n"), F.when(ok, "tested").otherwise("too_sparse").alias("verdict"))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(k) else upper_gamma(k / 2, a / 2) for a, k in zip(x, dof)], dtype=float)


def association(rows: DataFrame, r: str, c: str, classes: list) -> DataFrame:
    """A row for each value of ``r`` and each of ``classes``: how far the cell is from independence.

    count, row_size, share, baseline, expected, residual ((O - E) / root of E), odds_ratio (null if
    infinite), p (Fisher, two-sided), q (Benjamini-Hochberg over all cells), flag (q < 0.05 and a
    residual of at least 1.5). Values of ``c`` outside ``classes`` and nulls are left out.
    """
    t, tr, tc, n = _totals(rows.filter(F.col(c).isin(*classes)), r, c)
    kind = rows.schema[c].dataType
    cells = tr.select(r, "rt", F.explode(F.array(*[F.lit(x).cast(kind) for x in classes])).alias(c))
    x = cells.join(t, [r, c], "left").join(F.broadcast(tc), c, "left").join(F.broadcast(n))  # a row for each class; one row
    o, ct = F.coalesce("o", F.lit(0)), F.coalesce("ct", F.lit(0))
    b, e = F.col("rt") - o, ct - o
    d = F.col("n") - F.col("rt") - e
    want = F.col("rt").cast("double") * ct / F.col("n")
    x = x.select(
        r, c, o.alias("count"), F.col("rt").alias("row_size"), (o / F.col("rt")).alias("share"), (ct / F.col("n")).alias("baseline"), want.alias("expected"),
        F.when(want > 0, (o - want) / F.sqrt(want)).otherwise(F.lit(0.0)).alias("residual"),
        F.when(b * e > 0, o * d / (b * e)).alias("odds_ratio"), fisher_p(o, b, e, d).alias("p"),
    )
    q = bh(cut(x, "cells"), "p", [F.col(r), F.col(c)])
    return q.withColumn("flag", (F.col("q") < 0.05) & (F.abs("residual") >= 1.5))


def bh(rows: DataFrame, p: str, ties: list, block: int = 100_000) -> DataFrame:
    """Add q: Benjamini-Hochberg over all rows with a p; ``ties`` make the order total.

    The running least from the largest p down is taken in blocks of ranks, which are then joined
    by the least of the blocks behind, so that no task sees all rows.
    """
    known = rows.filter(F.col(p).isNotNull())
    at = positions(known.withColumn("__all", F.lit(0)), "__all", [F.col(p), *ties], "__k").drop("__all")
    n = known.agg(F.count("*").alias("__n"))
    v = at.join(F.broadcast(n)).withColumn("__v", F.col(p) * F.col("__n") / (F.col("__k") + 1)).withColumn("__b", F.floor(F.col("__k") / block))
    tails = v.groupBy("__b").agg(F.min("__v").alias("__m"))
    behind = Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    tails = tails.select("__b", F.min("__m").over(behind).alias("__m"))
    inside = Window.partitionBy("__b").orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
    out = v.withColumn("__v", F.min("__v").over(inside)).join(F.broadcast(tails), "__b")
    return out.withColumn("q", F.least(F.lit(1.0), F.col("__v"), F.coalesce("__m", F.lit(1.0)))).drop("__b", "__k", "__n", "__v", "__m")
