"""Descriptions of groups of rows: spreads, bands, cross tables, slices, differences of means."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.series import resample
from skein.functions.vectors import finite


def _fine(c: str) -> Column:
    return F.when(finite(F.col(c).cast("double")), F.col(c).cast("double"))


def describe(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, mean, sd, p25, median, p75 of the finite values; sd is that of a sample.

    Equal values of a group are counted before they are sorted, so that a group of many rows takes
    the place of its distinct values only. A group without finite values has n 0 and nulls.
    """
    counts = rows.groupBy(group, _fine(value).alias("__x")).agg(F.count(_fine(value)).alias("__n"))
    q = lambda p: F.percentile("__x", F.lit(p), F.col("__n"))
    n, s = F.sum("__n"), F.sum(F.col("__x") * F.col("__n"))
    out = counts.groupBy(group).agg(
        n.alias("n"), (s / n).alias("mean"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.min("__x").alias("least"), F.max("__x").alias("most"),
    )
    # from the mean, as differences of large squares lose digits
    around = rows.groupBy(group).agg(F.stddev_samp(_fine(value)).alias("sd"))
    return out.join(around.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).select(group, "n", "mean", "sd", "least", "p25", "median", "p75", "most")


def correlations(rows: DataFrame, columns: list[str], against: str, least: int = 4) -> DataFrame:
    """column, n, r: Pearson correlation over rows where both are finite.

    r is null below ``least`` rows or where either hardly varies (sd at most 1e-9).
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _fine(c).alias("x"), _fine(against).alias("y")) for c in columns])).alias("v"))
    pair = long.select("v.*").filter("x is not null and y is not null")
    g = pair.groupBy("column").agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return g.select("column", "n", F.when((F.col("n") >= least) & (F.col("sx") > 1e-9) & (F.col("sy") > 1e-9), F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).alias("r"))


def cohens_d(rows: DataFrame, group: str, a, b, columns: list[str]) -> DataFrame:
    """metric, d, n_a, n_b: difference of means over the pooled deviation, largest |d| first by rank.

    Null where a side has fewer than two finite values; 0 where the pooled variance is nearly none.
    """
    long = rows.filter(F.col(group).isin(a, b)).select(
        group, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), _fine(c).alias("x")) for c in columns])).alias("v")
    )
    side = lambda f, g: f(F.when(F.col(group) == g, F.col("v.x")))
    m = long.groupBy("v.metric").agg(
        *[e.alias(f"{n}_{k}") for k, g in (("a", a), ("b", b)) for n, e in (("n", side(F.count, g)), ("m", side(F.avg, g)), ("v", side(F.var_samp, g)))]
    )
    pooled = F.try_divide((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b"), F.col("n_a") + F.col("n_b") - 2)
    d = F.when((F.col("n_a") < 2) | (F.col("n_b") < 2), None).when(pooled <= 1e-12, F.lit(0.0)).otherwise((F.col("m_a") - F.col("m_b")) / F.sqrt(pooled))
    return m.select("metric", d.alias("d"), "n_a", "n_b")


def slices(rows: DataFrame, dimensions: list[str], measures: dict[str, Column]) -> DataFrame:
    """dimensions, level, measures: every combination of the dimensions down to the grand total.

    level names the dimensions of a row, so that a null of the data differs from "all".
    """
    subsets = [s for k in range(len(dimensions) + 1) for s in combinations(dimensions, k)]
    out = rows.groupingSets([list(s) for s in subsets], *dimensions).agg(F.grouping_id().alias("__g"), *[m.alias(n) for n, m in measures.items()])
    width = len(dimensions)
    names = F.filter(F.array(*[F.when(F.col("__g").bitwiseAND(F.lit(1 << (width - 1 - i))) == 0, F.lit(d)) for i, d in enumerate(dimensions)]), lambda x: x.isNotNull())
    return out.select(*dimensions, F.array_join(names, "+").alias("level"), *measures)


def crosstab(rows: DataFrame, r: str, c: str, values: list[str], other: list[str] | None = None) -> DataFrame:
    """r and a column of counts for each of ``values``; with ``other``, a row for each of those too."""
    counts = [F.count_if(F.col(c) == v).alias(v) for v in values]
    out = rows.groupBy(r).agg(*counts)
    if other is None:
        return out
    want = rows.sparkSession.createDataFrame([(x,) for x in other], f"`{r}` string")
    return want.join(out, r, "left").select(r, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def class_summary(rows: DataFrame, label: str, classes: list[str], means: list[str], middle: str) -> DataFrame:
    """label, n, share, median of ``middle``, means of the finite values: a row for each class, empty ones too."""
    total = rows.agg(F.count("*").alias("__t"))  # one row
    g = rows.groupBy(label).agg(F.count("*").alias("n"), F.median(_fine(middle)).alias(f"median_{middle}"), *[F.avg(_fine(m)).alias(f"mean_{m}") for m in means])
    want = rows.sparkSession.createDataFrame([(x,) for x in classes], f"`{label}` string")
    out = want.join(g, label, "left").join(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    share = F.when(F.col("__t") > 0, n / F.col("__t")).otherwise(F.lit(0.0))
    return out.select(label, n.alias("n"), share.alias("share"), f"median_{middle}", *[f"mean_{m}" for m in means])


def bands(rows: DataFrame, series: str, grid: int = 20) -> DataFrame:
    """step, q25, q50, q75 of all series read at ``grid`` even steps; series too short are left out."""
    g = rows.select(F.posexplode(resample(F.col(series), grid)).alias("step", "y")).filter(finite(F.col("y")))
    counts = g.groupBy("step", "y").agg(F.count("*").alias("n"))
    return counts.groupBy("step").agg(*[F.percentile("y", F.lit(p), F.col("n")).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])


def ragged_means(rows: DataFrame, label: str, series: str) -> DataFrame:
    """label, t, n, mean: mean of series of unlike lengths at each place; nulls and NaNs are skipped."""
    g = rows.select(label, F.posexplode(series).alias("t", "x")).filter(finite(F.col("x").cast("double")))
    return g.groupBy(label, "t").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))


def progress_mix(rows: DataFrame, label: str, at: str, bins: int = 10) -> DataFrame:
    """bin, label, n, share: labels in even bins of progress (0 to 1), shares within a bin."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(at) * bins)).cast("long").alias("bin")
    n = rows.groupBy(b, label).agg(F.count("*").alias("n"))
    total = n.groupBy("bin").agg(F.sum("n").alias("t"))
    return n.join(F.broadcast(total), "bin").select("bin", label, "n", (F.col("n") / F.col("t")).alias("share"))  # at most ``bins`` rows


def padded_range(low: Column, high: Column) -> tuple[Column, Column]:
    """(low, high) of an axis: nearly flat data get 0.03 on either side of their middle, others 8 % of their span."""
    span = high - low
    pad = F.when(span < 0.04, F.lit(0.03) - span / 2).otherwise(span * 0.08)
    middle = (low + high) / 2
    return middle - span / 2 - pad, middle + span / 2 + pad


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
