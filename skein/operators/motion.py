"""Trajectories to features, reference scales and ten motion weights."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.series import dip_recover, head_tail_delta, kept, late_mean, mean, rise_fall, std, step_shape, tail
from skein.functions.quantiles import quantiles
from skein.functions.vectors import finite
from skein.operators.clouds import cloud_series
from skein.session import cut

# The motions in their order and the bounds of their raw scores.
MOTIONS = ("translation", "diffusion", "condensation", "fission", "crystallization", "vortex", "orbit", "breathing", "cascade", "filamentation")
BOUNDS = ((-0.8, 3.6), (0, 2.9), (0, 2.6), (0, 3.5), (-0.6, 2.9), (-1.2, 2.7), (0, 2.9), (0, 2.7), (0, 2.7), (0, 3))
TEMPERATURE = 0.25
METHOD = "motion-mixture-v1"
#: Scale name -> the feature it is fitted on.
SCALES = {"sigma": "d_sigma", "dim": "d_dim", "k": "d_k", "chi": "d_chi", "m": "m_leave", "step": "chi_step_mean", "chi_std": "chi_late_std"}


def trajectories(rows: DataFrame, size: int = 10, wide: int = 30, keys: tuple[str, ...] = ("thread_id",)) -> DataFrame:
    """One row per sequence with its series in window order; rows: keys, pos, e."""
    return packed(cloud_series(rows, size, wide, keys), keys)


def packed(long: DataFrame, keys: tuple[str, ...] = ("thread_id",)) -> DataFrame:
    """One row per sequence with arrays of its series; long: keys, win, n and the series."""
    names = [c for c in ("sims", "adj_sims", "sigma", "eff_dim", "k_modes", "chi", "chi_step", "bimodality") if c in long.columns]
    ordered = F.array_sort(F.collect_list(F.struct("win", *[F.col(c).cast("double").alias(c) for c in names])))
    wide_rows = long.groupBy(*keys).agg(ordered.alias("w"), F.sum("n").alias("n_comments"), F.count("*").alias("n_windows"))
    pick = lambda c: F.transform("w", lambda s: s[c]).alias(c)
    return wide_rows.select(*keys, "n_comments", "n_windows", *[pick(c) for c in names]).withColumn("s_end", late_mean(F.col("sims")))


def features(rows: DataFrame) -> DataFrame:
    """Add the features a trajectory is scored by; rows have the series of :func:`trajectories`."""
    c = F.col
    sigma = kept(c("sigma"))
    low = F.array_min(sigma)
    # written, as later expressions use every feature many times
    out = rows.withColumns(
        {
            "m_leave": 1 - F.coalesce("s_end", F.element_at("sims", -1)),
            "m_wave": dip_recover(c("sims")),
            "m_step": step_shape(F.transform("sims", lambda x: 1 - x)),
            "d_sigma": head_tail_delta(c("sigma")),
            "d_dim": head_tail_delta(c("eff_dim")),
            "d_k": head_tail_delta(c("k_modes")),
            "d_chi": head_tail_delta(c("chi")),
            "sigma_wave": rise_fall(F.transform(sigma, lambda x: x - low)),
            "chi_wave": rise_fall(c("chi")),
            "chi_step_shape": step_shape(c("chi")),
            "chi_step_mean": mean(kept(F.slice("chi_step", 2, F.greatest(F.lit(1), F.size("chi_step"))))),
            "chi_late_std": std(tail(kept(c("chi")), 3)),
        }
    )
    return cut(out, "features")


def robust_scales(rows: DataFrame, columns: dict[str, str]) -> dict[str, float]:
    """name -> 1.4826 * median deviation from the median of the finite values of a column.

    At most 1e-6 gives way to the standard deviation (at least 0.001); fewer than four values to 1.
    """
    value = lambda c: F.when(finite(F.col(c).cast("double")), F.col(c).cast("double"))
    spread = rows.agg(*[x for n, c in columns.items() for x in (F.count(value(c)).alias(f"n_{n}"), F.stddev_pop(value(c)).alias(f"s_{n}"))]).first()
    mid = quantiles(rows, {n: (value(c), 0.5) for n, c in columns.items()})
    mad = quantiles(rows, {n: (F.abs(value(c) - F.lit(mid[n])), 0.5) for n, c in columns.items() if mid[n] is not None})
    out = {}
    for n in columns:
        s = (mad.get(n) or 0.0) * 1.4826
        out[n] = 1.0 if spread[f"n_{n}"] < 4 else s if s > 1e-6 else max(spread[f"s_{n}"], 1e-3)
    return out


def fit_scales(human: DataFrame) -> dict[str, float]:
    """The seven reference scales from feature rows of the human side only."""
    out = robust_scales(human, SCALES)
    return out | {"k": max(out["k"], 0.35)}


def fingerprint(scales: dict[str, float]) -> str:
    """SHA-256 of the scales as JSON with sorted keys: what rows scored with them carry."""
    return hashlib.sha256(json.dumps(scales, sort_keys=True).encode()).hexdigest()


def check_scales(scales: dict[str, float], temperature: float) -> None:
    """Raise ValueError unless all seven scales and the temperature are finite and positive."""
    bad = [n for n in SCALES if not 0 < scales.get(n, 0) < float("inf")]
    if bad or set(scales) != set(SCALES) or not 0 < temperature < float("inf"):
        raise ValueError(f"scales {bad} or temperature are not finite and positive")


def _stable(x: np.ndarray, s: float) -> np.ndarray:
    return np.where(np.isfinite(x), np.exp(-np.abs(np.nan_to_num(x)) / s), 0.0)


def _up(x: np.ndarray, s: float) -> np.ndarray:
    with np.errstate(over="ignore"):  # a large change saturates at 0 or 1
        return np.where(np.isfinite(x), 1 / (1 + np.exp(-np.nan_to_num(x) / s)), 0.0)


def raw_scores(f: dict[str, np.ndarray], scales: dict[str, float], decline_factor: float = 1.0) -> np.ndarray:
    """Raw score of each motion, a column each in the order of MOTIONS, from columns of features."""
    s = scales
    up = {n: _up(f[f"d_{n}"], s[n]) for n in ("sigma", "k", "chi")}
    down = {n: _up(-f[f"d_{n}"], s[n]) for n in ("sigma", "k", "chi")}
    still = {n: _stable(f[f"d_{n}"], s[n]) for n in ("sigma", "dim", "k", "chi")}
    move = np.clip(f["m_leave"] / (2 * s["m"] + 1e-9), 0, 1)
    stay = 1 - move
    freeze = _stable(f["chi_step_mean"], s["step"]) * _stable(f["chi_late_std"], s["chi_std"])
    flow = 1 - freeze
    decline = -np.expm1(-np.maximum(0, -np.nan_to_num(f["d_dim"])) / (s["dim"] * decline_factor))
    return np.column_stack(
        [
            1.4 * move + 0.6 * still["sigma"] + 0.4 * still["dim"] + 0.4 * still["k"] + 0.8 * still["chi"] - 0.8 * f["m_wave"],
            1.2 * up["sigma"] + up["chi"] + 0.4 * stay + 0.3 * still["k"],
            1.2 * down["sigma"] + down["chi"] + 0.4 * stay,
            up["sigma"] + 1.4 * up["k"] + 0.8 * down["chi"] + 0.3 * stay,
            1.6 * freeze + 0.5 * still["sigma"] + 0.4 * still["k"] + 0.4 * stay - 0.6 * flow,
            1.4 * flow + 0.5 * stay + 0.4 * still["sigma"] + 0.4 * still["k"] - 0.7 * f["chi_wave"] - 0.5 * freeze,
            1.3 * f["m_wave"] + 1.3 * f["chi_wave"] + 0.3 * still["sigma"],
            1.2 * f["sigma_wave"] + 1.2 * f["chi_wave"] + 0.3 * stay,
            1.3 * f["m_step"] + 1.1 * f["chi_step_shape"] + 0.3 * still["sigma"],
            decline * (2 + 0.5 * still["sigma"] + 0.5 * still["k"]),
        ]
    )


FEATURES = ("m_leave", "m_wave", "m_step", "d_sigma", "d_dim", "d_k", "d_chi", "sigma_wave", "chi_wave", "chi_step_shape", "chi_step_mean", "chi_late_std")


def motion_weights(rows: DataFrame, scales: dict[str, float], temperature: float = TEMPERATURE, decline_factor: float = 1.0) -> DataFrame:
    """Add r_ (raw), c_ (brought to [0, 1]) and w_ (weight) of the ten motions and what follows.

    Weights are a softmax and sum to 1. dominant_motion is the first of the highest; entropy is
    divided by its most. Rows with fewer than four windows are marked (resolved): their shape terms
    are 0. Each row carries the method, the temperature and the fingerprint of the scales. A score
    outside its bounds raises ValueError: no finite features give one.
    """
    check_scales(scales, temperature)
    rows = rows.withColumns({"resolved": F.col("n_windows") >= 4, "method": F.lit(METHOD), "temperature": F.lit(temperature), "scales": F.lit(fingerprint(scales))})
    low, high = (np.array(x, float) for x in zip(*BOUNDS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = raw_scores({n: f[n].to_numpy(float) for n in FEATURES}, scales, decline_factor)
            if not ((raw >= low - 1e-9) & (raw <= high + 1e-9)).all():
                raise ValueError("a raw score lies outside its bounds")
            c = (raw - low) / (high - low)
            w = np.exp((c - c.max(1, keepdims=True)) / temperature) if len(c) else c
            w = w / w.sum(1, keepdims=True)
            new = {f"{k}_{m}": v[:, i] for k, v in (("r", raw), ("c", c), ("w", w)) for i, m in enumerate(MOTIONS)}
            best = np.array(MOTIONS, object)[c.argmax(1)] if len(c) else []
            entropy = -(w * np.log(np.maximum(w, 1e-300))).sum(1) / np.log(10)
            yield f.assign(**new, dominant_motion=best, entropy=entropy)

    more = "".join(f", {k}_{m} double" for k in "rcw" for m in MOTIONS) + ", dominant_motion string, entropy double"
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema) + more
    return rows.mapInPandas(run, schema)


def as_maps(rows: DataFrame) -> DataFrame:
    """Rows of :func:`motion_weights` with raw_scores, compatibility and weights as maps by motion instead of columns."""
    columns = {"raw_scores": "r", "compatibility": "c", "weights": "w"}
    held = {n: F.create_map(*[x for m in MOTIONS for x in (F.lit(m), F.col(f"{k}_{m}"))]) for n, k in columns.items()}
    return rows.withColumns(held).drop(*[f"{k}_{m}" for k in columns.values() for m in MOTIONS])


def nine_class(rows: DataFrame, scales: dict[str, float]) -> DataFrame:
    """Add motion, score and margin: the first of the highest nine raw scores, and its lead."""
    check_scales(scales, 1.0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = raw_scores({n: f[n].to_numpy(float) for n in FEATURES}, scales)[:, :9]
            top = np.sort(raw, 1)[:, ::-1] if len(raw) else np.zeros((0, 2))
            best = np.array(MOTIONS, object)[raw.argmax(1)] if len(raw) else []
            yield f.assign(motion=best, score=top[:, 0], margin=top[:, 0] - top[:, 1])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)
    return rows.mapInPandas(run, schema + ", motion string, score double, margin double")


def side_mass(rows: DataFrame) -> DataFrame:
    """side, motion, mean_weight, mass: weights of each side; rows have side and w_<motion>."""
    long = rows.select("side", F.explode(F.array(*[F.struct(F.lit(m).alias("motion"), F.col(f"w_{m}").alias("w")) for m in MOTIONS])).alias("x"))
    return long.groupBy("side", "x.motion").agg(F.avg("x.w").alias("mean_weight"), F.sum("x.w").alias("mass"))


# Settings under which weights are looked at again (temperature, factor of the scale of dimension decline).
SETTINGS = {"tau_015": (0.15, 1.0), "tau_050": (0.5, 1.0), "filament_scale_05": (0.25, 0.5), "filament_scale_15": (0.25, 1.5)}


def sensitivity(rows: DataFrame, scales: dict[str, float], settings: dict[str, tuple[float, float]] = SETTINGS) -> DataFrame:
    """setting, motion, n_pairs, delta_pp: paired differences of weights under other settings."""
    out = None
    for name, (temperature, factor) in settings.items():
        w = motion_weights(rows, scales, temperature, factor)
        pair = _pairs(w).filter("h is not null and s is not null").groupBy("motion")
        one = pair.agg(F.count("*").alias("n_pairs"), (100 * F.avg(F.col("s") - F.col("h"))).alias("delta_pp")).select(F.lit(name).alias("setting"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _pairs(rows: DataFrame) -> DataFrame:
    long = rows.select("thread_id", "side", F.explode(F.array(*[F.struct(F.lit(m).alias("motion"), F.col(f"w_{m}").alias("w")) for m in MOTIONS])).alias("x"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("x.w")))
    return long.groupBy("thread_id", "x.motion").agg(of("human").alias("h"), of("sim").alias("s"))


def paired_delta(rows: DataFrame) -> DataFrame:
    """motion, delta_pp, n_positive: sim less human weight over complete pairs, in points."""
    return _pairs(rows).filter("h is not null and s is not null").groupBy("motion").agg(
        (100 * F.avg(F.col("s") - F.col("h"))).alias("delta_pp"), F.count_if(F.col("s") > F.col("h")).alias("n_positive")
    )


# The five radial shapes.
SHAPES = ("anchored", "translated_plateau", "keep_falling", "orbit", "other")


def shapes(rows: DataFrame) -> DataFrame:
    """Add the features of a curve and its shape, the first of five rules that holds.

    min_after and t_min: least value after the start and its first window; depth: how far below 1;
    recovery: the end above it; late_slope, late_std: least squares and deviation of the last three.
    All are null for fewer than three windows. rows: sims, s_end and more.
    """
    enough = F.size("sims") >= 3
    after, late = F.slice("sims", 2, F.greatest(F.lit(1), F.size("sims"))), tail(F.col("sims"), 3)
    m = F.array_min(after)
    out = rows.withColumns(
        {
            "min_after": F.when(enough, m), "t_min": F.when(enough, F.array_position(after, m)), "depth": F.when(enough, 1 - m), "recovery": F.when(enough, F.col("s_end") - m),
            "late_slope": F.when(enough, (F.element_at(late, -1) - F.element_at(late, 1)) / 2), "late_std": F.when(enough, std(late)),
        }
    )
    c = F.col
    shape = (
        F.when(~enough, "other").when((c("recovery") >= 0.12) & (c("recovery") >= 0.30 * c("depth")), "orbit")
        .when((c("min_after") >= 0.64) & (c("s_end") >= 0.70), "anchored").when((c("late_slope") >= -0.02) & (c("late_std") <= 0.045), "translated_plateau")
        .when(c("late_slope") < -0.025, "keep_falling").otherwise("other")
    )
    return out.withColumn("shape", shape)


def steps(rows: DataFrame, keys: tuple[str, ...] = ("thread_id",)) -> DataFrame:
    """One row per window after the first: changes of the series and chi, where chi is finite."""
    z = F.arrays_zip("sims", "sigma", "eff_dim", "bimodality", "chi_step")
    long = rows.select(*keys, "n_windows", F.posexplode(z).alias("t", "v"), z.alias("z")).filter("t > 0")
    prev = F.element_at("z", F.col("t"))
    d = lambda n: F.col(f"v.{n}") - prev[n]
    return long.select(
        *keys, F.col("t").cast("long").alias("t"), (F.col("t") / F.greatest(F.col("n_windows") - 1, F.lit(1))).alias("t_frac"), "n_windows",
        (-d("sims")).alias("delta_m"), d("sigma").alias("delta_sigma"), d("eff_dim").alias("delta_d"), d("bimodality").alias("delta_bimod"),
        F.col("v.chi_step").alias("chi"),
    ).filter(finite(F.col("chi")))


def step_cuts(rows: DataFrame) -> dict[str, float]:
    """The nine thresholds of step labels over the finite values of all steps."""
    fine = lambda c: F.when(finite(c), c)
    c = F.col
    wanted = {
        "chi_low": (c("chi"), 0.2), "sigma_lo": (c("delta_sigma"), 0.2), "sigma_hi": (c("delta_sigma"), 0.8), "d_lo": (c("delta_d"), 0.2),
        "bimod_hi": (c("delta_bimod"), 0.8), "m_move": (c("delta_m"), 0.75), "sigma_st": (F.abs("delta_sigma"), 0.5),
        "d_st": (F.abs("delta_d"), 0.5), "bimod_st": (F.abs("delta_bimod"), 0.5),
    }
    return quantiles(rows, {n: (fine(x), q) for n, (x, q) in wanted.items()})


def step_labels(rows: DataFrame) -> DataFrame:
    """Add motion to step rows by thresholds over all steps; NaN never satisfies a rule."""
    cuts = step_cuts(rows)
    c = F.col
    at = lambda n: F.lit(cuts[n]).cast("double")
    le = lambda x, y: F.coalesce(finite(x) & (x <= at(y)), F.lit(False))
    ge = lambda x, y: F.coalesce(finite(x) & (x >= at(y)), F.lit(False))
    quiet = le(F.abs("delta_sigma"), "sigma_st") & le(F.abs("delta_d"), "d_st") & le(F.abs("delta_bimod"), "bimod_st")
    motion = (
        F.when(le(c("chi"), "chi_low") & quiet, "crystallization").when(le(c("delta_sigma"), "sigma_lo"), "condensation")
        .when(ge(c("delta_bimod"), "bimod_hi"), "fission").when(le(c("delta_d"), "d_lo"), "filamentation")
        .when(ge(c("delta_sigma"), "sigma_hi"), "diffusion").when(ge(c("delta_m"), "m_move") & quiet, "translation")
        .otherwise("turnover_background")
    )
    return rows.withColumn("motion", motion)


def late_majority(rows: DataFrame, last: int = 3, keys: tuple[str, ...] = ("thread_id",)) -> DataFrame:
    """keys, label: the most frequent motion of the last steps; of equals the earliest."""
    near = rows.filter(F.col("t") >= F.greatest(F.lit(1), F.col("n_windows") - last))
    n = near.groupBy(*keys, "motion").agg(F.count("*").alias("n"), F.min("t").alias("t"))
    return n.groupBy(*keys).agg(F.max_by("motion", F.struct("n", -F.col("t"))).alias("label"))


def curve_notes(rows: DataFrame, turn: float = 0.12, drift: float = 0.05) -> DataFrame:
    """Add note_m, note_sigma, note_k, note_chi: what a reader would say of each series, as codes.

    m: returned, left, or stayed; the others: wave, up, down, or flat. rows: features of a trajectory.
    """
    c = F.col
    m = F.when(c("m_wave") >= 0.5, "returned").when(c("m_leave") >= turn, "left").otherwise("stayed")

    def moved(change: str, wave: str | None, least: float):
        start = F.when(c(wave) >= 0.5, "wave") if wave else F.when(F.lit(False), "wave")
        return start.when(finite(c(change)) & (c(change) >= least), "up").when(finite(c(change)) & (c(change) <= -least), "down").otherwise("flat")

    return rows.withColumns({"note_m": m, "note_sigma": moved("d_sigma", "sigma_wave", drift), "note_k": moved("d_k", None, 0.5), "note_chi": moved("d_chi", "chi_wave", turn)})
