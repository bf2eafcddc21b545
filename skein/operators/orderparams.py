"""Window statistics of vector sequences: centres, similarity curves, dispersion, dimension.

All operators take rows of (thread_id, pos, e) with unit vectors ``e`` of doubles, or the output of
one another; threads are bounded by the sequence they hold. Empty input gives empty output and
threads shorter than a window form one partial window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.quantiles import quantiles
from skein.functions.vectors import clip, dot, norm, unit


def mean_vectors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean, n: the mean vector of each group; partial sums are combined before the shuffle.

    Rows with a null vector are left out.
    """
    v = rows.filter("e is not null").withColumn("__v", array_to_vector("e"))
    mean = Summarizer.mean(F.col("__v"))
    return v.groupBy(*keys).agg(vector_to_array(mean).alias("mean"), F.count("*").alias("n"))


def tumbling(rows: DataFrame, size: int) -> DataFrame:
    """Add ``win``: blocks of ``size`` positions, the last one possibly partial."""
    return rows.withColumn("win", F.floor(F.col("pos") / size))


def support(rows: DataFrame, size: int, wide: int) -> DataFrame:
    """Rows repeated for each wider, centred window they support: win is the block.

    The window of block i ends at min(n, i*size - half + wide) with half = (wide - size) // 2 and
    starts ``wide`` earlier, but not before 0: at the head it shrinks, at the tail it slides.
    """
    n = rows.groupBy("thread_id").agg((F.max("pos") + 1).alias("n"))
    half = max(0, (wide - size) // 2)
    blocks = n.select("thread_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))).alias("win"))
    end = F.least("n", F.col("win") * size - half + wide)
    blocks = blocks.select("thread_id", "win", end.alias("end"), F.greatest(F.lit(0), end - wide).alias("start"))
    # an equi-join on the positions a window names, not a range join
    at = blocks.select("thread_id", "win", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    return at.join(rows, ["thread_id", "pos"])


def radial_curve(rows: DataFrame, size: int = 10) -> DataFrame:
    """thread_id, win, sim_first, sim_prev: cosine of each window's centre to the first and last."""
    centres = mean_vectors(tumbling(rows, size), ["thread_id", "win"]).withColumn("m", unit(F.col("mean")))
    w = Window.partitionBy("thread_id").orderBy("win")
    first, prev = F.first("m").over(w), F.lag("m").over(w)
    return centres.select(
        "thread_id", "win", clip(dot(F.col("m"), first), -1.0, 1.0).alias("sim_first"),
        F.coalesce(clip(dot(F.col("m"), prev), -1.0, 1.0), F.lit(1.0)).alias("sim_prev"), "n",
    )


def dispersion(rows: DataFrame, size: int = 10, wide: int = 30) -> DataFrame:
    """thread_id, win, sigma: mean cosine distance to the centre = 1 - length of the mean vector."""
    m = mean_vectors(support(rows, size, wide), ["thread_id", "win"])
    length = norm(F.col("mean"))
    sigma = F.when(F.col("n") < 2, F.lit(0.0)).when(length > 1e-12, 1 - length).otherwise(F.lit(1.0))
    return m.select("thread_id", "win", sigma.alias("sigma"), F.col("n").alias("n_support"))


@F.pandas_udf(T.DoubleType())
def _participation(windows: pd.Series) -> pd.Series:
    out = []
    for w in windows:
        x = np.stack([np.asarray(v, float) for v in w])
        k = x @ x.T
        square = float((k * k).sum())
        out.append(1.0 if len(x) < 2 else float(np.trace(k)) ** 2 / square if square > 1e-12 else 0.0)
    return pd.Series(out, dtype=float)


def effective_dim(rows: DataFrame, size: int = 10, wide: int = 30) -> DataFrame:
    """thread_id, win, eff_dim: participation ratio, squared trace over squared length of the kernel.

    The vectors of a window, at most ``wide``, come together in one row; no pairs are formed.
    """
    s = support(rows, size, wide).filter("e is not null").groupBy("thread_id", "win").agg(F.collect_list("e").alias("w"))
    return s.select("thread_id", "win", _participation("w").alias("eff_dim"))


def late(by: str, value: Column, last: int = 3) -> Column:
    """Aggregate: the mean of ``value`` over the last ``last`` windows of rows that carry n_windows."""
    return F.avg(F.when(F.col(by) >= F.col("n_windows") - last, value))


def with_count(curve: DataFrame) -> DataFrame:
    return curve.withColumn("n_windows", F.count("*").over(Window.partitionBy("thread_id")))


def s_end_scores(curve: DataFrame, last: int = 3, reach: float = 0.9, leave: float = 0.5) -> DataFrame:
    """Per thread: s_end, slope, distance from the start, first windows at ``reach`` and below ``leave``.

    t_tau is the first window whose similarity is at least ``reach``, the first window itself
    included; departure is the first later window below ``leave``. Both are null where there is none.
    """
    c = with_count(curve)
    return c.groupBy("thread_id").agg(
        late("win", F.col("sim_first"), last).alias("s_end"),
        F.coalesce(F.regr_slope("sim_first", "win"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.avg(F.when(F.col("win") > 0, 1 - F.col("sim_first"))), F.lit(0.0)).alias("distance"),
        F.min(F.when(F.col("sim_first") >= reach, F.col("win"))).alias("t_tau"),
        F.min(F.when((F.col("win") > 0) & (F.col("sim_first") < leave), F.col("win"))).alias("departure"),
        F.count("*").alias("n_windows"),
    )


def quantile_labels(scores: DataFrame, high: float = 0.8, low: float = 0.2) -> DataFrame:
    """Add label: converge at or above the high quantile of s_end, non_converge at or below the low."""
    cuts = quantiles(scores, {"hi": (F.col("s_end"), high), "lo": (F.col("s_end"), low)})
    at = lambda n: F.lit(cuts[n]).cast("double")
    label = F.when(F.col("s_end") >= at("hi"), "converge").when(F.col("s_end") <= at("lo"), "non_converge").otherwise("ambiguous")
    return scores.withColumn("label", label)


def corpus_mean(rows: DataFrame) -> DataFrame:
    """d, mu: the mean over all vectors, by dimension; empty if there are none."""
    mean = mean_vectors(rows, []).filter("n > 0")
    return mean.select(F.posexplode("mean").alias("d", "mu"))


def centred(rows: DataFrame, mu: DataFrame | None = None) -> DataFrame:
    """The rows with a mean taken off and vectors scaled to length 1 again.

    mu: one row with the array ``mu``, as kept from another corpus; the mean of the rows by default.
    """
    if mu is None:
        mu = mean_vectors(rows, []).select(F.col("mean").alias("mu"))
    # one row of as many numbers as a vector has
    moved = F.zip_with("e", "mu", lambda x, m: x - m)
    return rows.join(F.broadcast(mu)).withColumn("e", unit(moved)).drop("mu")


def text_windows(rows: DataFrame, size: int = 10) -> DataFrame:
    """thread_id, win, text: bodies of a window joined by blank lines; rows: thread_id, pos, body."""
    w = tumbling(rows, size).groupBy("thread_id", "win").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("b"))
    return w.select("thread_id", "win", F.array_join(F.transform("b", lambda s: s["body"]), "\n\n").alias("text"))
