import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import series as S
from skein.operators import motion as M
from skein.operators.contracts import demand, replay_audit, replay_violations, same_protocol, shared_titles, trajectory_violations, weight_violations

ZERO = ["d_sigma", "d_dim", "d_k", "d_chi", "m_leave", "chi_step_mean", "chi_late_std", "m_wave", "chi_wave", "sigma_wave", "m_step", "chi_step_shape"]
ONES = dict.fromkeys(M.SCALES, 1.0)


def test_golden_scores(spark):
    row = spark.range(1).select(F.lit(5).alias("n_windows"), *[F.lit(0.0).alias(z) for z in ZERO])
    got = M.motion_weights(row, ONES).collect()[0]
    raw = [2.2, 1.8, 1.5, 1.9, 2.9, 0.8, 0.3, 0.3, 0.3, 0.0]
    assert np.allclose([got[f"r_{m}"] for m in M.MOTIONS], raw, atol=1e-12)
    c = np.array([(r - lo) / (hi - lo) for r, (lo, hi) in zip(raw, M.BOUNDS)])
    w = np.exp((c - c.max()) / 0.25)
    assert np.allclose([got[f"w_{m}"] for m in M.MOTIONS], w / w.sum(), atol=1e-12)
    assert abs(sum(got[f"w_{m}"] for m in M.MOTIONS) - 1) < 1e-12


@pytest.mark.parametrize("scales,t", [({**ONES, "k": 0.0}, 0.25), (ONES, 0.0), (ONES, -1.0), (ONES, float("nan")), ({"k": 1.0}, 0.25)])
def test_bad_parameters(scales, t):
    with pytest.raises(ValueError):
        M.check_scales(scales, t)


def one(spark, expr, values):
    df = spark.createDataFrame([(values,)], "s array<double>")
    return df.select(expr(F.col("s")).alias("x")).collect()[0].x


def test_series_functions(spark):
    nan = float("nan")
    assert abs(one(spark, S.head_tail_delta, [1.0, nan, 2.0, 3.0, 7.0]) - (4.0 - 1.0)) < 1e-12
    assert math.isnan(one(spark, S.head_tail_delta, []))
    assert one(spark, S.dip_recover, [1.0, 0.7, 0.6, 1.0]) == 1.0 and one(spark, S.dip_recover, [1.0, 0.9, 0.8]) == 0.0
    assert abs(one(spark, S.rise_fall, [0.0, 0.4, 0.2, 0.2]) - 0.75) < 1e-12
    assert one(spark, S.step_shape, [0.0, 0.0, 1.0, 1.0]) == 1.0 and one(spark, S.step_shape, [1.0] * 5) == 0.0
    got = one(spark, S.resample, [0.0, 1.0, 4.0])
    assert len(got) == 20 and got[0] == 0.0 and got[-1] == 4.0 and abs(got[10] - np.interp(20 / 19, [0, 1, 2], [0, 1, 4])) < 1e-9


def trajectory(tid, side, shift=0.0, n=4):
    cut = lambda x: [float(v) for v in x][:n]
    return (tid, side, 10 * n, n, cut([1, 0.9, 0.7, 0.8]), 0.8, cut([0.2, 0.3, 0.4 + shift, 0.3 + shift]), cut([5, 4, 3, 2]), cut([1, 1, 2, 2]), cut([0, 0.3, 0.5, 0.2]), cut([0, 0.3, 0.2, 0.3]))


SCHEMA = "thread_id string, side string, n_comments long, n_windows long, sims array<double>, s_end double, sigma array<double>, eff_dim array<double>, k_modes array<double>, chi array<double>, chi_step array<double>"


def test_scales_come_from_the_human_side(spark):
    human = [trajectory(f"t{k}", "human", k / 10) for k in range(6)]
    sims = [trajectory(f"t{k}", "sim", 20.0 + k) for k in range(6)]
    rows = M.features(spark.createDataFrame(human + sims, SCHEMA))
    alone = M.features(spark.createDataFrame(human, SCHEMA))
    scales = M.fit_scales(rows.filter("side = 'human'"))
    assert scales == M.fit_scales(alone)
    weighted = M.motion_weights(rows, scales)
    assert weight_violations(weighted).count() == 0
    row = weighted.first()
    assert row.scales == M.fingerprint(scales) and row.method == M.METHOD and row.temperature == M.TEMPERATURE
    maps = M.as_maps(weighted).first()
    assert set(maps.weights) == set(M.MOTIONS) and abs(sum(maps.weights.values()) - 1) < 1e-12 and "w_orbit" not in maps
    mass = M.side_mass(weighted).groupBy("side").agg(F.sum("mean_weight").alias("w")).collect()
    assert all(abs(r.w - 1) < 1e-9 for r in mass)
    by = {(r.side, r.motion): r.mean_weight for r in M.side_mass(weighted).collect()}
    for r in M.paired_delta(weighted).collect():
        assert abs(r.delta_pp - 100 * (by[("sim", r.motion)] - by[("human", r.motion)])) < 1e-9


def test_contract(spark):
    good = [trajectory("a", "human"), trajectory("a", "sim")]
    nan_row = list(trajectory("b", "human"))
    nan_row[6] = [float("nan")] * 4
    reasons = lambda rows: {r.reason for r in trajectory_violations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert reasons(good) == set()
    assert reasons([]) == {"no trajectories"}
    assert reasons([*good, trajectory("a", "sim")]) == {"repeated"}
    assert reasons([trajectory("a", "human"), (*trajectory("a", "sim")[:2], 50, *trajectory("a", "sim")[3:])]) == {"paired n_comments differ"}
    assert reasons([(*good[0][:5], float("inf"), *good[0][6:])]) == {"end not finite"}
    mixed = spark.createDataFrame([(*good[0], "a"), (*trajectory("b", "human"), "b"), (*trajectory("c", "human"), None)], SCHEMA + ", embedder string")
    assert {r.reason for r in trajectory_violations(mixed).collect()} == {"mixed settings"}
    with pytest.raises(ValueError):
        demand(trajectory_violations(mixed), "trajectories")
    assert reasons([*good, trajectory("c", "sim")]) == {"incomplete pair"}
    assert "series of wrong length or not finite" in reasons([tuple(nan_row)])
    assert "fewer than two windows" in reasons([trajectory("d", "human", n=1)])
    assert "unknown side" in reasons([trajectory("e", "other")])


def test_weights_keep_their_contract(spark):
    rows = M.features(spark.createDataFrame([trajectory("a", "human"), trajectory("a", "sim", 0.5)], SCHEMA))
    w = M.motion_weights(rows, ONES).withColumn("title", F.lit("A"))
    assert [tuple(r) for r in shared_titles(w).collect()] == [("a", "A")]
    other = w.withColumn("title", F.col("side"))
    assert {r.reason for r in weight_violations(other).collect()} == {"paired title differ"}
    raised = w.withColumn("w_vortex", F.col("w_vortex") + 0.1)
    assert {r.reason for r in weight_violations(raised).collect()} == {"no distribution"}
    mixed = w.withColumn("temperature", F.when(F.col("side") == "sim", 0.5).otherwise(0.25))
    assert {r.reason for r in weight_violations(mixed).collect()} == {"mixed protocols"}
    for bad in (other, raised):
        with pytest.raises(ValueError):
            shared_titles(bad)
    with pytest.raises(ValueError):
        same_protocol({"embedder": "x"}, spark.createDataFrame([("y",)], "embedder string"))
    same_protocol({"embedder": "y"}, spark.createDataFrame([("y",)], "embedder string"))


def test_score_outside_its_bounds_is_an_error(spark):
    row = spark.range(1).select(F.lit(5).alias("n_windows"), *[F.lit(9.0).alias(z) for z in ZERO])
    with pytest.raises(Exception, match="outside its bounds"):
        M.motion_weights(row, ONES).collect()


HUMAN = "post_id string, position long, author string, alias string, comment_id string, body string"
SIM = "file_id string, position long, author string, alias string, comment_id string, body string, error string, shown_indices array<long>, truncated boolean"


def test_replay_contract(spark):
    human = spark.createDataFrame([("p", i, "x", "A", str(i), "human text") for i in range(2)], HUMAN)
    head = spark.createDataFrame([("p", "p", 2)], "post_id string, file_id string, n_turns long")
    turn = {"file_id": "p", "author": "x", "alias": "A", "body": "sim text", "error": None, "truncated": False}
    good = [{**turn, "position": i, "comment_id": str(i), "shown_indices": list(range(i))} for i in range(2)]

    def reasons(change=None, heads=head, n=2):
        rows = [dict(r) for r in good[:n]]
        if change:
            rows[1].update(change)
        return {r.reason for r in replay_violations(human, heads, spark.createDataFrame(rows, SIM)).collect()}

    assert reasons() == set()
    assert reasons({"body": " "}) == {"failed or empty simulation"} and reasons({"error": "failed"}) == {"failed or empty simulation"}
    assert reasons({"author": "wrong"}) == {"author differs"} and reasons({"position": 99}) == {"position differs"}
    assert reasons({"shown_indices": [1]}) == {"invalid visible history"} and reasons({"shown_indices": None}) == {"invalid visible history"}
    assert "turn counts differ" in reasons(n=1)
    assert reasons(heads=head.limit(0)) == {"missing header"}
    assert reasons(heads=head.withColumn("post_id", F.lit("q"))) == {"thread id differs"}
    audit = replay_audit(human, head, spark.createDataFrame(good, SIM), size=1).collect()
    assert [(r.post_id, r.n_turns, r.valid, r.reason) for r in audit] == [("p", 2, True, None)]
    assert replay_audit(human, head, spark.createDataFrame(good, SIM)).first().reason == "fewer than two windows"
