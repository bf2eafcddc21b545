"""Queries over vector clouds: curves, order parameters, motions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import clouds, describe, motion, orderparams
from skein.sources.views import cloud, paired_cloud


def _r(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def radial_curve(spark: SparkSession, d: str) -> DataFrame:
    return orderparams.radial_curve(cloud(spark, d)).select("thread_id", "win", *_r("sim_first", "sim_prev"))


def s_end_scores(spark: SparkSession, d: str) -> DataFrame:
    s = orderparams.s_end_scores(orderparams.radial_curve(cloud(spark, d)))
    return s.select("thread_id", *_r("s_end", "slope", "distance"), "t_tau", "departure", "n_windows")


def quantile_labels(spark: SparkSession, d: str) -> DataFrame:
    s = orderparams.s_end_scores(orderparams.radial_curve(cloud(spark, d)))
    return orderparams.quantile_labels(s).select("thread_id", *_r("s_end"), "label")


def dispersion(spark: SparkSession, d: str) -> DataFrame:
    return orderparams.dispersion(cloud(spark, d)).select("thread_id", "win", *_r("sigma"), "n_support")


def effective_dim(spark: SparkSession, d: str) -> DataFrame:
    return orderparams.effective_dim(cloud(spark, d)).select("thread_id", "win", *_r("eff_dim"))


def corpus_mean_vector(spark: SparkSession, d: str) -> DataFrame:
    return orderparams.corpus_mean(cloud(spark, d)).select("d", *_r("mu"))


def centred_curve(spark: SparkSession, d: str) -> DataFrame:
    c = orderparams.radial_curve(orderparams.centred(cloud(spark, d)))
    return c.select("thread_id", "win", *_r("sim_first", "sim_prev"))


def cloud_series(spark: SparkSession, d: str) -> DataFrame:
    return clouds.cloud_series(cloud(spark, d))


def cloud_summary(spark: SparkSession, d: str) -> DataFrame:
    """First and late values of all series of each cloud."""
    return clouds.summary(clouds.cloud_series(cloud(spark, d)))


def vendi_windows(spark: SparkSession, d: str) -> DataFrame:
    return clouds.vendi_means(cloud(spark, d)).select("thread_id", "win", *_r("value"))


def late_effective_dim(spark: SparkSession, d: str) -> DataFrame:
    return clouds.late_pooled(cloud(spark, d)).select("thread_id", "n", *_r("eff_dim"))


def late_vendi(spark: SparkSession, d: str) -> DataFrame:
    return clouds.late_pooled(cloud(spark, d)).select("thread_id", *_r("vendi"))


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows of both sides, thread by thread."""
    keys = ("thread_id", "side")
    return motion.features(motion.trajectories(paired_cloud(spark, d), 5, 15, keys))


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = _paired(spark, d)
    return motion.motion_weights(rows, motion.fit_scales(rows.filter("side = 'human'")))


def cloud_features(spark: SparkSession, d: str) -> DataFrame:
    return _paired(spark, d).select("thread_id", "side", *_r(*motion.FEATURES))


def cloud_weights(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d).select("thread_id", "side", *_r(*[f"w_{m}" for m in motion.MOTIONS], "entropy"), "dominant_motion", "resolved")


def curve_shapes(spark: SparkSession, d: str) -> DataFrame:
    c = orderparams.radial_curve(cloud(spark, d))
    rows = c.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("win", "sim_first"))).alias("w"))
    rows = rows.select("thread_id", F.transform("w", lambda s: s["sim_first"]).alias("sims"))
    scores = orderparams.s_end_scores(c).select("thread_id", "s_end")
    return motion.shapes(rows.join(scores, "thread_id")).select("thread_id", "shape")


def resampled_band(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of the curves of all threads over 20 steps of progress."""
    c = orderparams.radial_curve(cloud(spark, d)).groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("win", "sim_first"))).alias("w"))
    return describe.bands(c.select(F.transform("w", lambda s: s["sim_first"]).alias("y")), "y")


NAMES = (
    "radial_curve s_end_scores quantile_labels dispersion effective_dim corpus_mean_vector centred_curve cloud_series cloud_summary "
    "vendi_windows late_effective_dim late_vendi cloud_features cloud_weights curve_shapes resampled_band"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

_CLOUD = """
WITH cloud AS (SELECT vec_id // 100 AS thread_id, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1 AS pos, embedding FROM embeddings),
flat AS (SELECT thread_id, pos, unnest(generate_series(1, len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM cloud)"""
_CURVE = """,
mv AS (SELECT thread_id, pos // 10 AS win, d, avg(x) AS x FROM flat GROUP BY ALL),
nv AS (SELECT thread_id, win, sqrt(sum(x * x)) AS n FROM mv GROUP BY ALL),
cv AS (SELECT thread_id, win, d, CASE WHEN n > 1e-12 THEN x / n ELSE x END AS x FROM mv JOIN nv USING (thread_id, win)),
c1 AS (SELECT a.thread_id, a.win, greatest(-1, least(1, sum(a.x * b.x))) AS sim_first FROM cv a JOIN cv b ON a.thread_id = b.thread_id AND a.d = b.d AND b.win = 0 GROUP BY ALL),
c2 AS (SELECT a.thread_id, a.win, greatest(-1, least(1, sum(a.x * b.x))) AS sim_prev FROM cv a JOIN cv b ON a.thread_id = b.thread_id AND a.d = b.d AND b.win = a.win - 1 GROUP BY ALL),
curve AS (SELECT thread_id, win, sim_first, coalesce(sim_prev, 1.0) AS sim_prev, count(*) OVER (PARTITION BY thread_id) AS n_windows FROM c1 LEFT JOIN c2 USING (thread_id, win)),
scores AS (SELECT thread_id, avg(sim_first) FILTER (win >= n_windows - 3) AS s_end, coalesce(regr_slope(sim_first, win), 0.0) AS slope,
  coalesce(avg(1 - sim_first) FILTER (win > 0), 0.0) AS distance, min(win) FILTER (sim_first >= 0.9) AS t_tau, min(win) FILTER (win > 0 AND sim_first < 0.5) AS departure, count(*) AS n_windows FROM curve GROUP BY 1)"""
_SUPPORT = """,
n AS (SELECT thread_id, max(pos) + 1 AS n FROM cloud GROUP BY 1),
blocks AS (SELECT thread_id, n, unnest(generate_series(0, (n - 1) // 10)) AS win FROM n),
spans AS (SELECT thread_id, win, least(n, win * 10 - 10 + 30) AS e, greatest(0, least(n, win * 10 - 10 + 30) - 30) AS s FROM blocks)"""

ORACLES = {
    "radial_curve": _CLOUD + _CURVE + " SELECT thread_id, win, round(sim_first, 6) AS sim_first, round(sim_prev, 6) AS sim_prev FROM curve",
    "s_end_scores": _CLOUD + _CURVE + " SELECT thread_id, round(s_end, 6) AS s_end, round(slope, 6) AS slope, round(distance, 6) AS distance, t_tau, departure, n_windows FROM scores",
    "quantile_labels": _CLOUD + _CURVE + """ SELECT thread_id, round(s_end, 6) AS s_end,
  CASE WHEN s_end >= (SELECT quantile_cont(s_end, 0.8) FROM scores) THEN 'converge' WHEN s_end <= (SELECT quantile_cont(s_end, 0.2) FROM scores) THEN 'non_converge' ELSE 'ambiguous' END AS label FROM scores""",
    "dispersion": _CLOUD + _SUPPORT + """,
m AS (SELECT thread_id, win, d, avg(x) AS x, count(*) AS n FROM flat JOIN spans USING (thread_id) WHERE pos >= s AND pos < e GROUP BY ALL)
SELECT thread_id, win, round(CASE WHEN max(n) < 2 THEN 0 ELSE 1 - sqrt(sum(x * x)) END, 6) AS sigma, max(n) AS n_support FROM m GROUP BY ALL""",
    "effective_dim": _CLOUD + _SUPPORT + """,
w AS (SELECT c.thread_id, win, pos, embedding FROM cloud c JOIN spans USING (thread_id) WHERE pos >= s AND pos < e),
g AS (SELECT a.thread_id, a.win, sum(pow(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2)) AS k2,
    sum(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) FILTER (a.pos = b.pos) AS tr, count(DISTINCT a.pos) AS n
  FROM w a JOIN w b ON a.thread_id = b.thread_id AND a.win = b.win GROUP BY ALL)
SELECT thread_id, win, round(CASE WHEN n < 2 THEN 1 ELSE tr * tr / k2 END, 6) AS eff_dim FROM g""",
    "late_effective_dim": _CLOUD + """,
l AS (SELECT c.thread_id, pos, embedding FROM cloud c JOIN (SELECT thread_id, max(pos) // 10 AS w FROM cloud GROUP BY 1) USING (thread_id) WHERE pos // 10 > w - 3),
g AS (SELECT a.thread_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS k, a.pos = b.pos AS same FROM l a JOIN l b USING (thread_id))
SELECT thread_id, count(*) FILTER (same) AS n, round(sum(k) FILTER (same) * sum(k) FILTER (same) / sum(k * k), 6) AS eff_dim FROM g GROUP BY 1""",
    "corpus_mean_vector": _CLOUD + " SELECT CAST(d - 1 AS INTEGER) AS d, round(avg(x), 6) AS mu FROM flat GROUP BY 1",
    "curve_shapes": _CLOUD + _CURVE + """,
late AS (SELECT thread_id, win, sim_first, n_windows, row_number() OVER (PARTITION BY thread_id ORDER BY win DESC) AS r FROM curve),
f AS (SELECT l.thread_id, max(n_windows) AS n, min(sim_first) FILTER (win > 0) AS m, regr_slope(sim_first, win) FILTER (r <= 3) AS slope, stddev_pop(sim_first) FILTER (r <= 3) AS sd, avg(sim_first) FILTER (r <= 3) AS e
  FROM late l GROUP BY 1)
SELECT thread_id, CASE WHEN n < 3 THEN 'other' WHEN e - m >= 0.12 AND e - m >= 0.30 * (1 - m) THEN 'orbit' WHEN m >= 0.64 AND e >= 0.70 THEN 'anchored'
  WHEN slope >= -0.02 AND sd <= 0.045 THEN 'translated_plateau' WHEN slope < -0.025 THEN 'keep_falling' ELSE 'other' END AS shape FROM f""",
    "resampled_band": _CLOUD + _CURVE + """,
l AS (SELECT thread_id, list(sim_first ORDER BY win) AS y FROM curve GROUP BY 1),
g AS (SELECT thread_id, y, unnest(generate_series(0, 19)) AS step FROM l WHERE len(y) >= 2),
p AS (SELECT step, y, step / 19.0 * (len(y) - 1) AS p, CAST(floor(step / 19.0 * (len(y) - 1)) AS INTEGER) AS lo FROM g),
v AS (SELECT step, y[lo + 1] + (y[least(lo + 2, len(y))] - y[lo + 1]) * (p - lo) AS v FROM p)
SELECT CAST(step AS INTEGER) AS step, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75 FROM v GROUP BY 1""",
    "centred_curve": _CLOUD + """,
mu AS (SELECT d, avg(x) AS mu FROM flat GROUP BY 1),
moved AS (SELECT thread_id, pos, d, x - mu AS x FROM flat JOIN mu USING (d)),
len AS (SELECT thread_id, pos, sqrt(sum(x * x)) AS l FROM moved GROUP BY ALL),
flat2 AS (SELECT thread_id, pos, d, x / l AS x FROM moved JOIN len USING (thread_id, pos))"""
    + _CURVE.replace("FROM flat GROUP", "FROM flat2 GROUP") + " SELECT thread_id, win, round(sim_first, 6) AS sim_first, round(sim_prev, 6) AS sim_prev FROM curve",
}
