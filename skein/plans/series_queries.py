"""Queries over series of windows: features, scales, motion weights, steps, shapes, contracts.

The series are read off the events (:func:`skein.sources.views.event_series`), so that plain SQL can
work out the same from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.vectors import finite
from skein.operators import clouds, contracts, describe, motion, picks, topics
from skein.operators.motion import BOUNDS, FEATURES, MOTIONS, SCALES
from skein.session import cut
from skein.sources.views import event_series

KEYS = ("thread_id", "side")


def _r(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def _trajectories(spark: SparkSession, d: str) -> DataFrame:
    return motion.packed(event_series(spark, d), KEYS)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return motion.features(_trajectories(spark, d))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    rows = _features(spark, d)
    return cut(motion.motion_weights(rows, motion.fit_scales(rows.filter("side = 'human'"))), "weights")


def series_windows(spark: SparkSession, d: str) -> DataFrame:
    names = ("sims", "sigma", "eff_dim", "k_modes", "chi", "chi_step", "bimodality")
    return event_series(spark, d).select(*KEYS, "win", "n", *_r(*names))


def order_param_summary(spark: SparkSession, d: str) -> DataFrame:
    s = event_series(spark, d).withColumns({"adj_sims": F.col("sims"), "churn": F.lit(None).cast("double")})
    names = [f"{c}_{k}" for c in ("sigma", "eff_dim", "k_modes", "bimodality", "chi") for k in ("first", "late", "delta")]
    return clouds.summary(s, KEYS).select(*KEYS, *_r("s_end", *names, "chi_mean", "chi_range", "chi_step_mean"), "n_comments", "n_windows")


def trajectory_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select(*KEYS, *_r(*FEATURES))


def robust_scales(spark: SparkSession, d: str) -> DataFrame:
    scales = motion.fit_scales(_features(spark, d).filter("side = 'human'"))
    return spark.createDataFrame([(n, round(s, 6)) for n, s in sorted(scales.items())], "name string, scale double")


def motion_weights(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d).select(*KEYS, *_r(*[f"w_{m}" for m in MOTIONS], "entropy"), "dominant_motion", "resolved")


def nine_class_argmax(spark: SparkSession, d: str) -> DataFrame:
    rows = _features(spark, d)
    return motion.nine_class(rows, motion.fit_scales(rows.filter("side = 'human'"))).select(*KEYS, "motion", *_r("score", "margin"))


def class_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts, shares, median margin and mean end of the nine classes, empty ones too."""
    rows = _features(spark, d)
    c = motion.nine_class(rows, motion.fit_scales(rows.filter("side = 'human'")))
    out = describe.class_summary(c, "motion", list(MOTIONS[:9]), ["s_end"], "margin")
    return out.select("motion", "n", *_r("share", "median_margin", "mean_s_end"))


def audit_examples(spark: SparkSession, d: str) -> DataFrame:
    """The two clearest threads of each class, or its nearest miss."""
    rows = _features(spark, d)
    scales = motion.fit_scales(rows.filter("side = 'human'"))
    both = motion.motion_weights(motion.nine_class(rows, scales), scales).withColumn("post_id", F.concat_ws("_", "thread_id", "side"))
    return picks.winners(both, MOTIONS[:9]).select("class", "pick", "post_id", "rank", *_r("margin"))


def side_mass(spark: SparkSession, d: str) -> DataFrame:
    return motion.side_mass(_weights(spark, d)).select("side", "motion", *_r("mean_weight", "mass"))


def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    s = topics.weight_summary(_weights(spark, d))
    return s.select("motion", "n_pairs", *_r("delta_pp"), "n_positive")


def total_variation(spark: SparkSession, d: str) -> DataFrame:
    return topics.total_variation(_weights(spark, d)).select("n", *_r("mean_total_variation"))


def sliced_weights(spark: SparkSession, d: str) -> DataFrame:
    """Mean weights of two motions by side, by length and by both, down to the grand total."""
    w = _weights(spark, d).withColumn("long", F.when(F.col("n_windows") >= 7, "long").otherwise("short"))
    measures = {"n": F.count("*"), "translation": F.round(F.avg("w_translation"), 6), "fission": F.round(F.avg("w_fission"), 6)}
    return describe.slices(w, ["side", "long"], measures)


def sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Paired differences under other temperatures and a wider or narrower scale of the dimension."""
    rows = _features(spark, d)
    return motion.sensitivity(rows, motion.fit_scales(rows.filter("side = 'human'"))).select("setting", "motion", "n_pairs", *_r("delta_pp"))


def step_features(spark: SparkSession, d: str) -> DataFrame:
    return motion.steps(_trajectories(spark, d), KEYS).select(*KEYS, "t", "n_windows", *_r("t_frac", "delta_m", "delta_sigma", "delta_d", "delta_bimod", "chi"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return cut(motion.steps(_trajectories(spark, d), KEYS), "steps")


def step_thresholds(spark: SparkSession, d: str) -> DataFrame:
    cuts = motion.step_cuts(_steps(spark, d))
    return spark.createDataFrame([(n, round(v, 6)) for n, v in sorted(cuts.items())], "name string, value double")


def step_labels(spark: SparkSession, d: str) -> DataFrame:
    return motion.step_labels(_steps(spark, d)).select(*KEYS, "t", "motion")


def late_majority(spark: SparkSession, d: str) -> DataFrame:
    return motion.late_majority(motion.step_labels(_steps(spark, d)), keys=KEYS)


def progress_mix(spark: SparkSession, d: str) -> DataFrame:
    return describe.progress_mix(motion.step_labels(_steps(spark, d)), "motion", "t_frac").select("bin", "motion", "n", *_r("share"))


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    return motion.shapes(_trajectories(spark, d))


def shape_features(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(spark, d).select(*KEYS, *_r("min_after", "depth", "recovery", "late_slope", "late_std"), "t_min", "shape")


def shape_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return describe.crosstab(_shapes(spark, d), "side", "shape", list(motion.SHAPES), ["human", "sim"])


def shape_means(spark: SparkSession, d: str) -> DataFrame:
    """Counts and means of each shape."""
    g = describe.class_summary(_shapes(spark, d), "shape", list(motion.SHAPES), ["s_end", "min_after", "recovery", "late_std"], "s_end")
    return g.select("shape", "n", *_r("share", "median_s_end", "mean_s_end", "mean_min_after", "mean_recovery", "mean_late_std"))


def shape_example(spark: SparkSession, d: str) -> DataFrame:
    s = _shapes(spark, d).withColumn("key", F.concat_ws("_", "thread_id", "side"))
    return picks.typical(s, "shape", "s_end", "recovery", "n_windows", 8, "key").select("shape", "key", *_r("s_end"))


def ragged_mean(spark: SparkSession, d: str) -> DataFrame:
    return describe.ragged_means(_shapes(spark, d), "shape", "sims").select("shape", F.col("t").cast("long").alias("t"), "n", *_r("mean"))


def axis_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Range of the axis on which each side's curves are drawn."""
    s = event_series(spark, d).groupBy("side").agg(F.min("sigma").alias("lo"), F.max("sigma").alias("hi"))
    low, high = describe.padded_range(F.col("lo"), F.col("hi"))
    return s.select("side", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def describe_series(spark: SparkSession, d: str) -> DataFrame:
    return describe.describe(_features(spark, d), "side", "d_sigma").select("side", "n", *_r("mean", "sd", "least", "p25", "median", "p75", "most"))


def correlations(spark: SparkSession, d: str) -> DataFrame:
    return describe.correlations(_features(spark, d), ["d_sigma", "d_dim", "d_k", "d_chi"], "s_end").select("column", "n", *_r("r"))


def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    return describe.cohens_d(_features(spark, d), "side", "sim", "human", ["m_leave", "d_sigma", "d_dim", "d_k"]).select("metric", *_r("d"), "n_a", "n_b")


def curve_notes(spark: SparkSession, d: str) -> DataFrame:
    """What a reader would say of each series, as codes."""
    return motion.curve_notes(_features(spark, d)).select(*KEYS, "note_m", "note_sigma", "note_k", "note_chi")


def trajectory_contract(spark: SparkSession, d: str) -> DataFrame:
    return contracts.trajectory_violations(_trajectories(spark, d))


def weight_contract(spark: SparkSession, d: str) -> DataFrame:
    return contracts.weight_violations(_weights(spark, d))


NAMES = (
    "series_windows order_param_summary trajectory_features robust_scales motion_weights nine_class_argmax class_summary audit_examples side_mass "
    "paired_delta total_variation sliced_weights sensitivity step_features step_thresholds step_labels late_majority progress_mix shape_features "
    "shape_crosstab shape_means shape_example ragged_mean axis_ranges describe_series correlations cohens_d curve_notes trajectory_contract weight_contract"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

_S = """
WITH e AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS win, value, event_type FROM events),
g AS (SELECT user_id, win, count(*) AS n, avg(value) AS y, stddev_pop(value) AS sd, count(DISTINCT event_type) AS kinds, count(DISTINCT floor(value / 40)) AS bands,
  count(*) FILTER (event_type = 'click') / count(*) AS clicks, count(*) FILTER (value > 50) / count(*) AS high FROM e GROUP BY 1, 2),
f AS (SELECT user_id, y AS y0, clicks AS c0 FROM g WHERE win = 0),
s AS (SELECT g.user_id // 2 AS thread_id, CASE WHEN g.user_id % 2 = 0 THEN 'human' ELSE 'sim' END AS side, g.win, g.n, round(1 / (1 + abs(g.y - y0) / 50), 9) AS sims, round(g.sd / 100, 9) AS sigma,
  CAST(g.kinds AS DOUBLE) AS eff_dim, CAST(least(g.bands, 5) AS DOUBLE) AS k_modes, round(abs(g.clicks - c0), 9) AS chi,
  round(coalesce(abs(g.clicks - p.clicks), 0.0), 9) AS chi_step, round(g.high, 9) AS bimodality, count(*) OVER (PARTITION BY g.user_id) AS nw
  FROM g JOIN f USING (user_id) LEFT JOIN g p ON p.user_id = g.user_id AND p.win = g.win - 1)"""


def _step_sql(name: str, value: str) -> str:
    return f""",
{name}_d AS (SELECT thread_id, side, win, nw, {value} AS y, abs({value} - lag({value}) OVER (PARTITION BY thread_id, side ORDER BY win)) AS d FROM s),
{name}_j AS (SELECT thread_id, side, max(d) AS top, sum(d) AS total, arg_min(win, {{'d': -d, 'w': win}}) FILTER (d IS NOT NULL) AS jw FROM {name}_d GROUP BY 1, 2),
{name}_t AS (SELECT thread_id, side, stddev_pop(y) AS sd, count(*) AS k FROM {name}_d JOIN {name}_j USING (thread_id, side) WHERE win >= jw GROUP BY 1, 2),
{name} AS (SELECT thread_id, side, CASE WHEN nw < 4 OR total <= 1e-12 THEN 0.0 ELSE least(1.0, top / total * CASE WHEN k >= 2 THEN exp(-sd / (top + 1e-9)) ELSE 1 END) END AS v
  FROM (SELECT DISTINCT thread_id, side, nw FROM s) JOIN {name}_j USING (thread_id, side) JOIN {name}_t USING (thread_id, side))"""


def _rise_sql(name: str, value: str) -> str:
    return f""",
{name}_v AS (SELECT thread_id, side, win, nw, {value} AS y FROM s),
{name} AS (SELECT thread_id, side, CASE WHEN max(nw) < 4 OR max(y) < 0.12 OR arg_min(win, {{'y': -y, 'w': win}}) IN (0, max(nw) - 1) THEN 0.0
  ELSE (max(y) - (max(y) FILTER (win = 0) + max(y) FILTER (win = nw - 1)) / 2) / max(y) END AS v FROM {name}_v GROUP BY 1, 2)"""


_F = (
    _S
    + _step_sql("ms", "(1 - sims)") + _step_sql("cs", "chi") + _rise_sql("cw", "chi")
    + _rise_sql("sw", "sigma - min(sigma) OVER (PARTITION BY thread_id, side)")
    + """,
a AS (SELECT thread_id, side, max(nw) AS nw, avg(sims) FILTER (win >= nw - 3) AS s_end, 1 - avg(sims) FILTER (win >= nw - 3) AS m_leave,
  CASE WHEN max(nw) < 4 OR max(sims) FILTER (win = 0) - min(sims) < 0.04 OR arg_min(win, {'y': sims, 'w': win}) IN (0, max(nw) - 1) THEN 0.0
    ELSE greatest(0.0, least(1.0, (max(sims) FILTER (win = nw - 1) - min(sims)) / (max(sims) FILTER (win = 0) - min(sims)) * least(1.0, (max(sims) FILTER (win = 0) - min(sims)) / 0.12))) END AS m_wave,
  avg(sigma) FILTER (win >= nw - 3) - avg(sigma) FILTER (win < greatest(1, nw // 3)) AS d_sigma, avg(eff_dim) FILTER (win >= nw - 3) - avg(eff_dim) FILTER (win < greatest(1, nw // 3)) AS d_dim,
  avg(k_modes) FILTER (win >= nw - 3) - avg(k_modes) FILTER (win < greatest(1, nw // 3)) AS d_k, avg(chi) FILTER (win >= nw - 3) - avg(chi) FILTER (win < greatest(1, nw // 3)) AS d_chi,
  avg(chi_step) FILTER (win > 0) AS chi_step_mean, stddev_pop(chi) FILTER (win >= nw - 3) AS chi_late_std FROM s GROUP BY 1, 2),
ft AS (SELECT a.*, ms.v AS m_step, cs.v AS chi_step_shape, cw.v AS chi_wave, sw.v AS sigma_wave
  FROM a JOIN ms USING (thread_id, side) JOIN cs USING (thread_id, side) JOIN cw USING (thread_id, side) JOIN sw USING (thread_id, side))"""
)
_SCALE = _F + """,
long AS (SELECT name, x FROM (SELECT """ + ", ".join(f"{c} AS {n}" for n, c in SCALES.items()) + """ FROM ft WHERE side = 'human') UNPIVOT (x FOR name IN (""" + ", ".join(SCALES) + """))),
md AS (SELECT name, quantile_cont(x, 0.5) AS m FROM long GROUP BY 1),
sc AS (SELECT name, greatest(CASE WHEN name = 'k' THEN 0.35 ELSE 0 END, CASE WHEN count(*) < 4 THEN 1.0 WHEN 1.4826 * quantile_cont(abs(x - m), 0.5) > 1e-6 THEN 1.4826 * quantile_cont(abs(x - m), 0.5)
  ELSE greatest(stddev_pop(x), 1e-3) END) AS scale FROM long JOIN md USING (name) GROUP BY 1)"""  # fmt: skip


def _scored(scales: str, tau: str) -> str:
    """Scores and weights in long form; ``scales`` yields one row of s_<name>, perhaps of each setting."""
    up = "1 / (1 + exp(-d_{0} / s_{0}))"
    down = "1 / (1 + exp(d_{0} / s_{0}))"
    still = "exp(-abs(d_{0}) / s_{0})"
    p = ", ".join(
        [f"{up.format(n)} AS up_{n}, {down.format(n)} AS dn_{n}" for n in ("sigma", "k", "chi")] + [f"{still.format(n)} AS st_{n}" for n in ("sigma", "dim", "k", "chi")]
    )
    raw = {
        "translation": "1.4 * move + 0.6 * st_sigma + 0.4 * st_dim + 0.4 * st_k + 0.8 * st_chi - 0.8 * m_wave",
        "diffusion": "1.2 * up_sigma + up_chi + 0.4 * (1 - move) + 0.3 * st_k",
        "condensation": "1.2 * dn_sigma + dn_chi + 0.4 * (1 - move)",
        "fission": "up_sigma + 1.4 * up_k + 0.8 * dn_chi + 0.3 * (1 - move)",
        "crystallization": "1.6 * frz + 0.5 * st_sigma + 0.4 * st_k + 0.4 * (1 - move) - 0.6 * (1 - frz)",
        "vortex": "1.4 * (1 - frz) + 0.5 * (1 - move) + 0.4 * st_sigma + 0.4 * st_k - 0.7 * chi_wave - 0.5 * frz",
        "orbit": "1.3 * m_wave + 1.3 * chi_wave + 0.3 * st_sigma",
        "breathing": "1.2 * sigma_wave + 1.2 * chi_wave + 0.3 * (1 - move)",
        "cascade": "1.3 * m_step + 1.1 * chi_step_shape + 0.3 * st_sigma",
        "filamentation": "(1 - exp(-greatest(0.0, -d_dim) / s_fil)) * (2 + 0.5 * st_sigma + 0.5 * st_k)",
    }
    values = ", ".join(f"({k}, '{m}', {lo}, {hi})" for k, (m, (lo, hi)) in enumerate(zip(MOTIONS, BOUNDS)))
    return f""",
sw1 AS ({scales}),
pt AS (SELECT ft.*, sw1.*, {p}, greatest(0.0, least(1.0, m_leave / (2 * s_m + 1e-9))) AS move, exp(-abs(chi_step_mean) / s_step) * exp(-abs(chi_late_std) / s_chi_std) AS frz FROM ft, sw1),
rw AS (SELECT * FROM (SELECT setting, tau, thread_id, side, nw, s_end, {", ".join(f"{v} AS {m}" for m, v in raw.items())} FROM pt) UNPIVOT (r FOR motion IN ({", ".join(MOTIONS)}))),
bd AS (SELECT * FROM (VALUES {values}) b(k, motion, lo, hi)),
cm AS (SELECT rw.*, k, (r - lo) / (hi - lo) AS c FROM rw JOIN bd USING (motion)),
wt AS (SELECT *, exp((c - max(c) OVER w) / tau) / sum(exp(c / tau)) OVER w * exp(max(c) OVER w / tau) AS wg FROM cm WINDOW w AS (PARTITION BY setting, thread_id, side))"""


_ONE = "SELECT 'base' AS setting, 0.25 AS tau, " + ", ".join(f"(SELECT scale FROM sc WHERE name = '{n}') AS s_{n}" for n in SCALES) + ", (SELECT scale FROM sc WHERE name = 'dim') AS s_fil"
_W = _SCALE + _scored(_ONE, "tau")
_NINE = _W + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY thread_id, side ORDER BY r DESC, k) AS q FROM wt WHERE k < 9),
nc AS (SELECT thread_id, side, max(s_end) AS s_end, max(motion) FILTER (q = 1) AS motion, max(r) FILTER (q = 1) AS score, max(r) FILTER (q = 1) - max(r) FILTER (q = 2) AS margin FROM rk GROUP BY 1, 2)"""
_STEPS = _S + """,
st AS (SELECT * FROM (SELECT thread_id, side, win AS t, nw AS n_windows, win / greatest(nw - 1, 1) AS t_frac, lag(sims) OVER w - sims AS delta_m, sigma - lag(sigma) OVER w AS delta_sigma,
  eff_dim - lag(eff_dim) OVER w AS delta_d, bimodality - lag(bimodality) OVER w AS delta_bimod, chi_step AS chi FROM s WINDOW w AS (PARTITION BY thread_id, side ORDER BY win)) WHERE t > 0),
q AS (SELECT quantile_cont(chi, 0.2) AS chi_low, quantile_cont(delta_sigma, 0.2) AS sigma_lo, quantile_cont(delta_sigma, 0.8) AS sigma_hi, quantile_cont(delta_d, 0.2) AS d_lo, quantile_cont(delta_bimod, 0.8) AS bimod_hi,
  quantile_cont(delta_m, 0.75) AS m_move, quantile_cont(abs(delta_sigma), 0.5) AS sigma_st, quantile_cont(abs(delta_d), 0.5) AS d_st, quantile_cont(abs(delta_bimod), 0.5) AS bimod_st FROM st),
lb AS (SELECT st.*, CASE WHEN chi <= chi_low AND quiet THEN 'crystallization' WHEN delta_sigma <= sigma_lo THEN 'condensation' WHEN delta_bimod >= bimod_hi THEN 'fission' WHEN delta_d <= d_lo THEN 'filamentation'
  WHEN delta_sigma >= sigma_hi THEN 'diffusion' WHEN delta_m >= m_move AND quiet THEN 'translation' ELSE 'turnover_background' END AS motion
  FROM (SELECT *, abs(delta_sigma) <= sigma_st AND abs(delta_d) <= d_st AND abs(delta_bimod) <= bimod_st AS quiet FROM st, q) st)"""
_SHAPE = _S + """,
sh AS (SELECT thread_id, side, max(nw) AS n_windows, avg(sims) FILTER (win >= nw - 3) AS s_end, min(sims) FILTER (win > 0) AS min_after, arg_min(win, {'y': sims, 'w': win}) FILTER (win > 0) AS t_min,
  regr_slope(sims, win) FILTER (win >= nw - 3) AS late_slope, stddev_pop(sims) FILTER (win >= nw - 3) AS late_std FROM s GROUP BY 1, 2),
sp AS (SELECT *, 1 - min_after AS depth, s_end - min_after AS recovery, CASE WHEN n_windows < 3 THEN 'other' WHEN s_end - min_after >= 0.12 AND s_end - min_after >= 0.3 * (1 - min_after) THEN 'orbit'
  WHEN min_after >= 0.64 AND s_end >= 0.7 THEN 'anchored' WHEN late_slope >= -0.02 AND late_std <= 0.045 THEN 'translated_plateau' WHEN late_slope < -0.025 THEN 'keep_falling' ELSE 'other' END AS shape FROM sh)"""
_SHAPES = "(SELECT * FROM (VALUES ('anchored'), ('translated_plateau'), ('keep_falling'), ('orbit'), ('other')) v(shape))"


def _cols(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_SETTINGS = " UNION ALL ".join(
    f"SELECT '{n}' AS setting, {tau} AS tau, " + ", ".join(f"(SELECT scale FROM sc WHERE name = '{x}') AS s_{x}" for x in SCALES) + f", (SELECT scale FROM sc WHERE name = 'dim') * {fil} AS s_fil"
    for n, tau, fil in (("tau_015", 0.15, 1), ("tau_050", 0.5, 1), ("filament_scale_05", 0.25, 0.5), ("filament_scale_15", 0.25, 1.5))
)
_PAIR = """,
pr AS (SELECT setting, motion, thread_id, max(wg) FILTER (side = 'human') AS h, max(wg) FILTER (side = 'sim') AS s FROM wt GROUP BY 1, 2, 3)"""

ORACLES = {
    "series_windows": _S + f" SELECT thread_id, side, win, n, {_cols('sims', 'sigma', 'eff_dim', 'k_modes', 'chi', 'chi_step', 'bimodality')} FROM s",
    "order_param_summary": _S + """ SELECT thread_id, side, round(avg(sims) FILTER (win >= nw - 3), 6) AS s_end, """
    + ", ".join(
        f"round(max({c}) FILTER (win = 0), 6) AS {c}_first, round(avg({c}) FILTER (win >= nw - 3), 6) AS {c}_late, round(avg({c}) FILTER (win >= nw - 3) - max({c}) FILTER (win = 0), 6) AS {c}_delta"
        for c in ("sigma", "eff_dim", "k_modes", "bimodality", "chi")
    )
    + ", round(avg(chi), 6) AS chi_mean, round(max(chi) - min(chi), 6) AS chi_range, round(avg(chi_step) FILTER (win > 0), 6) AS chi_step_mean, CAST(sum(n) AS BIGINT) AS n_comments, count(*) AS n_windows FROM s GROUP BY 1, 2",
    "trajectory_features": _F + f" SELECT thread_id, side, {_cols(*FEATURES)} FROM ft",
    "robust_scales": _SCALE + f" SELECT name, {_cols('scale')} FROM sc",
    "motion_weights": _W + " SELECT thread_id, side, " + ", ".join(f"round(max(wg) FILTER (motion = '{m}'), 6) AS w_{m}" for m in MOTIONS)
    + ", round(-sum(wg * ln(wg)) / ln(10), 6) AS entropy, arg_min(motion, {'w': -c, 'k': k}) AS dominant_motion, max(nw) >= 4 AS resolved FROM wt GROUP BY 1, 2",
    "nine_class_argmax": _NINE + " SELECT thread_id, side, motion, round(score, 6) AS score, round(margin, 6) AS margin FROM nc",
    "class_summary": _NINE + """ SELECT b.motion, count(nc.motion) AS n, round(count(nc.motion) / (SELECT count(*) FROM nc), 6) AS share, round(quantile_cont(margin, 0.5), 6) AS median_margin,
  round(avg(s_end), 6) AS mean_s_end FROM bd b LEFT JOIN nc ON nc.motion = b.motion WHERE b.k < 9 GROUP BY 1""",
    "audit_examples": _NINE + """,
w1 AS (SELECT motion AS class, 'winner' AS pick, concat(thread_id, '_', side) AS post_id, row_number() OVER (PARTITION BY motion ORDER BY margin DESC, score DESC, concat(thread_id, '_', side)) AS rank, margin FROM nc),
w2 AS (SELECT rk.motion AS class, 'near_miss' AS pick, concat(thread_id, '_', side) AS post_id, row_number() OVER (PARTITION BY rk.motion ORDER BY r DESC, concat(thread_id, '_', side)) AS rank, margin
  FROM rk JOIN nc USING (thread_id, side) WHERE rk.motion NOT IN (SELECT motion FROM nc))
SELECT class, pick, post_id, CAST(rank AS INTEGER) AS rank, round(margin, 6) AS margin FROM w1 WHERE rank <= 2 UNION ALL SELECT class, pick, post_id, CAST(rank AS INTEGER), round(margin, 6) FROM w2 WHERE rank = 1""",
    "side_mass": _W + " SELECT side, motion, round(avg(wg), 6) AS mean_weight, round(sum(wg), 6) AS mass FROM wt GROUP BY 1, 2",
    "paired_delta": _W + _PAIR + " SELECT motion, count(h - s) AS n_pairs, round(100 * avg(s - h), 6) AS delta_pp, count(*) FILTER (s > h) AS n_positive FROM pr GROUP BY 1",
    "total_variation": _W + _PAIR + ", tv AS (SELECT thread_id, sum(abs(s - h)) / 2 AS v FROM pr GROUP BY 1) SELECT count(v) AS n, round(avg(v), 6) AS mean_total_variation FROM tv",
    "sliced_weights": _W + """,
wl AS (SELECT thread_id, side, CASE WHEN max(nw) >= 7 THEN 'long' ELSE 'short' END AS long, max(wg) FILTER (motion = 'translation') AS a, max(wg) FILTER (motion = 'fission') AS b FROM wt GROUP BY 1, 2)
SELECT side, long, CASE grouping(side, long) WHEN 0 THEN 'side+long' WHEN 1 THEN 'side' WHEN 2 THEN 'long' ELSE '' END AS level, count(*) AS n, round(avg(a), 6) AS translation, round(avg(b), 6) AS fission
FROM wl GROUP BY GROUPING SETS ((), (side), (long), (side, long))""",
    "sensitivity": _SCALE + _scored(_SETTINGS, "tau") + _PAIR + " SELECT setting, motion, count(h - s) AS n_pairs, round(100 * avg(s - h), 6) AS delta_pp FROM pr GROUP BY 1, 2",
    "step_features": _STEPS + f" SELECT thread_id, side, t, n_windows, {_cols('t_frac', 'delta_m', 'delta_sigma', 'delta_d', 'delta_bimod', 'chi')} FROM st",
    "step_thresholds": _STEPS + " SELECT name, round(value, 6) AS value FROM q UNPIVOT (value FOR name IN (chi_low, sigma_lo, sigma_hi, d_lo, bimod_hi, m_move, sigma_st, d_st, bimod_st))",
    "step_labels": _STEPS + " SELECT thread_id, side, t, motion FROM lb",
    "late_majority": _STEPS + """,
c AS (SELECT thread_id, side, motion, count(*) AS n, min(t) AS t FROM lb WHERE t >= greatest(1, n_windows - 3) GROUP BY 1, 2, 3)
SELECT thread_id, side, arg_min(motion, {'n': -n, 't': t}) AS label FROM c GROUP BY 1, 2""",
    "progress_mix": _STEPS + """,
b AS (SELECT CAST(least(9, floor(t_frac * 10)) AS BIGINT) AS bin, motion, count(*) AS n FROM lb GROUP BY 1, 2) SELECT bin, motion, n, round(n / sum(n) OVER (PARTITION BY bin), 6) AS share FROM b""",
    "shape_features": _SHAPE + f" SELECT thread_id, side, {_cols('min_after', 'depth', 'recovery', 'late_slope', 'late_std')}, t_min, shape FROM sp",
    "shape_crosstab": _SHAPE + " SELECT side, " + ", ".join(f"count(*) FILTER (shape = '{s}') AS {s}" for s in ("anchored", "translated_plateau", "keep_falling", "orbit", "other")) + " FROM sp GROUP BY 1",
    "shape_means": _SHAPE + f""" SELECT v.shape, count(sp.shape) AS n, round(count(sp.shape) / (SELECT count(*) FROM sp), 6) AS share, round(quantile_cont(s_end, 0.5), 6) AS median_s_end, round(avg(s_end), 6) AS mean_s_end,
  round(avg(min_after), 6) AS mean_min_after, round(avg(recovery), 6) AS mean_recovery, round(avg(late_std), 6) AS mean_late_std FROM {_SHAPES} v LEFT JOIN sp ON sp.shape = v.shape GROUP BY 1""",
    "shape_example": _SHAPE + """,
m AS (SELECT shape, avg(s_end) AS v, avg(recovery) AS o FROM sp GROUP BY 1),
d AS (SELECT shape, concat(thread_id, '_', side) AS key, s_end, row_number() OVER (PARTITION BY shape ORDER BY abs(s_end - v) + 0.5 * abs(recovery - o), abs(n_windows - 8), concat(thread_id, '_', side)) AS r FROM sp JOIN m USING (shape))
SELECT shape, key, round(s_end, 6) AS s_end FROM d WHERE r = 1""",
    "ragged_mean": _SHAPE + " SELECT shape, win AS t, count(*) AS n, round(avg(sims), 6) AS mean FROM sp JOIN s USING (thread_id, side) GROUP BY 1, 2",
    "axis_ranges": _S + """, r AS (SELECT side, min(sigma) AS lo, max(sigma) AS hi FROM s GROUP BY 1)
SELECT side, round(CASE WHEN hi - lo < 0.04 THEN (lo + hi) / 2 - 0.03 ELSE lo - 0.08 * (hi - lo) END, 6) AS low, round(CASE WHEN hi - lo < 0.04 THEN (lo + hi) / 2 + 0.03 ELSE hi + 0.08 * (hi - lo) END, 6) AS high FROM r""",
    "describe_series": _F + """ SELECT side, count(d_sigma) AS n, round(avg(d_sigma), 6) AS mean, round(stddev_samp(d_sigma), 6) AS sd, round(min(d_sigma), 6) AS least, round(quantile_cont(d_sigma, 0.25), 6) AS p25,
  round(quantile_cont(d_sigma, 0.5), 6) AS median, round(quantile_cont(d_sigma, 0.75), 6) AS p75, round(max(d_sigma), 6) AS most FROM ft GROUP BY 1""",
    "correlations": _F + """ SELECT "column", count(*) AS n, round(corr(x, s_end), 6) AS r FROM (SELECT s_end, d_sigma, d_dim, d_k, d_chi FROM ft) UNPIVOT (x FOR "column" IN (d_sigma, d_dim, d_k, d_chi)) GROUP BY 1""",
    "cohens_d": _F + """,
u AS (SELECT side, metric, x FROM (SELECT side, m_leave, d_sigma, d_dim, d_k FROM ft) UNPIVOT (x FOR metric IN (m_leave, d_sigma, d_dim, d_k))),
v AS (SELECT metric, side, avg(x) AS m, var_samp(x) AS v, count(*) AS n FROM u GROUP BY 1, 2)
SELECT a.metric, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS d, a.n AS n_a, b.n AS n_b FROM v a JOIN v b ON a.metric = b.metric AND a.side = 'sim' AND b.side = 'human'""",
    "trajectory_contract": _S + """,
t AS (SELECT thread_id, side, max(nw) AS n, CAST(sum(n) AS BIGINT) AS c FROM s GROUP BY 1, 2),
p AS (SELECT thread_id, count(*) AS k, max(n) - min(n) AS dn, max(c) - min(c) AS dc FROM t GROUP BY 1)
SELECT CAST(thread_id AS VARCHAR) AS thread_id, CAST(NULL AS VARCHAR) AS side, CASE WHEN k < 2 THEN 'incomplete pair' WHEN dn > 0 THEN 'paired n_windows differ' ELSE 'paired n_comments differ' END AS reason
FROM p WHERE k < 2 OR dn > 0 OR dc > 0
UNION ALL SELECT CAST(thread_id AS VARCHAR), side, 'fewer than two windows' FROM t WHERE n < 2""",
    "weight_contract": _W + """, k AS (SELECT thread_id, count(DISTINCT side) AS k FROM wt GROUP BY 1)
SELECT CAST(thread_id AS VARCHAR) AS thread_id, CAST(NULL AS VARCHAR) AS side, 'incomplete pair' AS reason FROM k WHERE k < 2""",
}
