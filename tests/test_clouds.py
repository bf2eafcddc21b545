import itertools

import numpy as np
from pyspark.sql import functions as F

from skein.functions.quantiles import quantiles
from skein.operators import clouds as C
from skein.operators import orderparams as O
from skein.operators.ordering import positions
from skein.operators.stats import fisher_two_sided
from skein.sources.readers import dump, history, replay
from skein.streaming.count_windows import count_windows


def blobs(n=15, dim=8):
    x = np.zeros((2 * n, dim))
    x[:n, 0] = 1
    x[n:, 1] = 1
    return x


def test_camps_and_vendi():
    assert C.camps(blobs()) == 2 and C.camps(np.eye(6)) == 1 and C.camps(np.ones((40, 1))) == 1
    assert abs(C.vendi(np.eye(5)) - 1) < 1e-9 and C.vendi(np.ones((1, 1))) == 0.0


def test_assignment_is_least():
    rnd = np.random.default_rng(0)
    for n, m in ((3, 3), (4, 6), (5, 3)):
        cost = rnd.random((n, m))
        small = cost if n <= m else cost.T
        best = min(np.mean([small[i, p[i]] for i in range(len(small))]) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert abs(C.assignment(cost) - best) < 1e-12


def test_turns_of_a_still_cloud():
    x = np.tile(np.array([[1.0, 0, 0]]), (30, 1))
    chi, step = C.turns(x, [np.arange(k, k + 10) for k in (0, 10, 20)])
    assert chi == [0.0] * 3 and step == [0.0] * 3


def frame(spark, x):
    return spark.createDataFrame([(0, k, [float(v) for v in e]) for k, e in enumerate(x)], "thread_id long, pos long, e array<double>")


def test_order_parameters(spark):
    rnd = np.random.default_rng(3)
    for n in (1, 9, 31):
        x = rnd.normal(size=(n, 6))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = frame(spark, x)
        s = {r.win: r for r in O.dispersion(df).collect()}
        d = {r.win: r.eff_dim for r in O.effective_dim(df).collect()}
        for i in range(-(-n // 10)):
            end = min(n, i * 10 - 10 + 30)
            part = x[max(0, end - 30) : end]
            assert s[i].n_support == len(part)
            if len(part) > 1:
                m = part.mean(0) / np.linalg.norm(part.mean(0))
                assert abs(s[i].sigma - np.mean(1 - part @ m)) < 1e-9
                k = np.linalg.eigvalsh(part @ part.T)
                assert abs(d[i] - k.sum() ** 2 / (k**2).sum()) < 1e-6
            else:
                assert s[i].sigma == 0.0 and d[i] == 1.0
    assert O.radial_curve(df.limit(0)).count() == 0


def plain_turns(x, blocks):
    """Turns of blocks from the definition, over singular vectors."""
    flat = (x - x.mean(0)) @ np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2].T
    mu = [flat[b].mean(0) for b in blocks]
    spread = [np.mean([np.linalg.norm(p - m) for p in flat[b]]) + 1e-9 for b, m in zip(blocks, mu)]
    centre = [x[b].mean(0) / np.linalg.norm(x[b].mean(0)) for b in blocks]

    def axis(p):
        if len(p) < 3:
            return None
        values, vectors = np.linalg.eigh(np.cov(p.T))
        return None if values[1] <= 1e-12 or values[1] / max(values[0], 1e-12) < 2.5 else np.arctan2(vectors[1, 1], vectors[0, 1])

    tilt = [axis(flat[b]) for b in blocks]

    def by_axis(i, j):
        if tilt[i] is None or tilt[j] is None:
            return 0.0
        d = abs(tilt[i] - tilt[j]) % np.pi
        return min(d, np.pi - d) / (np.pi / 2)

    def pair(i, j):
        if centre[i] @ centre[j] >= 0.92:
            return 0.0
        r = [np.linalg.norm(m) for m in mu]
        if r[i] < 2 * spread[i] and r[j] < 2 * spread[j]:
            return by_axis(i, j)
        if min(r[i], r[j]) < min(2 * spread[i], 2 * spread[j]):
            return by_axis(i, j)
        a, b = (np.arctan2(mu[k][1], mu[k][0]) for k in (i, j))
        return 0.5 * (1 - np.cos(a - b))

    n = range(len(blocks))
    return [pair(i, 0) if i else 0.0 for i in n], [pair(i, i - 1) if i else 0.0 for i in n]


def walk(rnd, n, dim=6):
    x = np.cumsum(rnd.normal(size=(n, dim)), 0) * 0.4 + rnd.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_turns_against_the_definition():
    rnd = np.random.default_rng(5)
    for _ in range(60):
        x = walk(rnd, int(rnd.integers(11, 80)))
        blocks = [np.arange(a, min(len(x), a + 10)) for a in range(0, len(x), 10)]
        for got, want in zip(C.turns(x, blocks), plain_turns(x, blocks)):
            assert np.allclose(got, want, atol=1e-9)


def test_long_sequences_give_the_same_series(spark):
    rnd = np.random.default_rng(6)
    rows = [(k, p, [float(v) for v in e]) for k, n in ((0, 47), (1, 130), (2, 1), (3, 40)) for p, e in enumerate(walk(rnd, n))]
    df = spark.createDataFrame(rows + [(9, None, None)], "thread_id long, pos long, e array<double>")
    whole = {(r.thread_id, r.win): r.asDict() for r in C.cloud_series(df).collect()}
    split = {(r.thread_id, r.win): r.asDict() for r in C.cloud_series(df, chunk=4).collect()}
    assert whole.keys() == split.keys() and len(whole) == 5 + 13 + 1 + 4
    for k, a in whole.items():
        for c, v in a.items():
            b = split[k][c]
            assert (v is None and b is None) or abs(v - b) < 1e-8, (k, c)
    assert C.cloud_series(df.limit(0)).count() == 0
    s = {r.thread_id: r for r in C.summary(C.cloud_series(df)).collect()}
    sims = [whole[(1, w)]["sims"] for w in range(13)]
    assert abs(s[1].s_end - np.mean(sims[-3:])) < 1e-9 and s[2].n_windows == 1 and np.isnan(s[2].churn_mean)


def test_vendi_draws(spark):
    df = frame(spark, np.eye(12))
    whole = {r.win: r.value for r in C.vendi_means(df, 6).collect()}
    drawn = {r.win: r.value for r in C.vendi_means(df, 12, sample=5, repeats=2).collect()}
    assert abs(whole[0] - 1) < 1e-9 and abs(drawn[0] - 1) < 1e-9


def test_quantiles_narrow_to_the_exact_value(spark):
    rnd = np.random.default_rng(7)
    x = np.concatenate([rnd.normal(size=900), np.full(700, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(4)
    for q in (0.0, 0.01, 0.25, 0.5, 0.777, 1.0):
        got = quantiles(df, {"a": (F.col("x"), q)}, small=50)["a"]
        assert abs(got - np.quantile(x, q)) < 1e-9, q
    assert quantiles(df.limit(0), {"a": (F.col("x"), 0.5)}) == {"a": None}


def test_positions_over_partitions(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 3).alias("g"), F.xxhash64("id").alias("o"))
    got = positions(df, "g", [F.col("o"), F.col("id")]).collect()
    for g in range(3):
        rows = sorted((r.o, r.id) for r in got if r.g == g)
        assert [r.pos for r in sorted((r for r in got if r.g == g), key=lambda r: (r.o, r.id))] == list(range(len(rows)))


def test_fisher():
    assert abs(fisher_two_sided(3, 1, 1, 3) - 0.4857142857) < 1e-9 and fisher_two_sided(0, 0, 3, 4) == 1.0


def test_readers(spark, tmp_path):
    import zstandard

    lines = [
        '{"post": {"id": "p", "title": "T"}, "comments": [{"id": "a", "body": " x ", "author": ""}, {"id": "b", "body": "[deleted]"}]}',
        "", '{"post": {"id": "q"}, "comments": []}', "{broken",
    ]
    (tmp_path / "d.jsonl.zst").write_bytes(zstandard.compress("\n".join(lines).encode()))
    got = dump(spark, str(tmp_path / "d.jsonl.zst")).collect()
    assert [r.post_id for r in got] == ["p"] and got[0].comments[0].body == "x" and got[0].comments[0].author == "[unknown]"
    (tmp_path / "r.jsonl").write_text('{"type": "meta", "post_id": "p", "n_turns": 2}\n{"position": 0, "body": "hi"}\n{"position": 1, "bo')
    head, turns = replay(spark, str(tmp_path / "r.jsonl"))
    assert head.collect()[0].n_turns == 2 and turns.filter("body is not null").count() == 1
    (tmp_path / "h.jsonl").write_text('{"author": "a", "records": [{"body": "b", "link_id": "t3_x"}, {"body": "", "selftext": "s", "name": "t3_y"}]}')
    assert {(r.post_id, r.body) for r in history(spark, str(tmp_path / "h.jsonl")).collect()} == {("x", "b"), ("y", "s")}


def test_count_windows_stream(spark, tmp_path):
    rows = spark.range(25).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"), F.col("id").cast("double").alias("v"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = count_windows(stream, "k", "o", "v", 5).writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.key, r.win): r["mean"] for r in spark.table("counted").collect()}
    assert got == {("0", 0): 4.0, ("0", 1): 14.0, ("1", 0): 5.0, ("1", 1): 15.0}
