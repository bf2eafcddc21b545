import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import describe, personas, picks, stats, topics
from skein.operators.discussion import clipped, linearise, post_text, unusable


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_cast_and_aliases_go_by_first_appearance(spark):
    t = frame(spark, [("p", a, k) for k, a in enumerate("zzaabbc")], "post_id string, author string, pos long")
    assert [(r.author, r.alias) for r in picks.cast_of(t, 3, 2).orderBy("r").collect()] == [("z", "Agent-1"), ("a", "Agent-2"), ("b", "Agent-3")]
    assert picks.cast_of(t, 4, 2).count() == 0 and picks.cast_of(t.limit(0), 1, 1).count() == 0
    assert {r.author: r.k for r in picks.aliases(t).collect()} == {"z": 1, "a": 2, "b": 3, "c": 4}


def test_merges(spark):
    rows = frame(spark, [("a", 1, 0, "x"), ("a", 2, 1, "y"), (None, 3, 0, "n"), ("", 4, 1, "e"), ("b", 5, 0, "z")], "id string, v long, o long, seen_by string")
    assert {(r.id, r.v) for r in picks.merged(rows, "id", ["o", "v"]).collect()} == {("a", 1), ("b", 5), (None, 3), ("", 4)}
    assert {(r.id, r.v, r.seen.o) for r in picks.merged(rows, "id", ["o", "v"], last=True).collect()} == {("a", 2, 0), ("b", 5, 0)}


def test_spread_and_medians(spark):
    rows = frame(spark, [("g", f"i{k:02d}", "x" * k) for k in range(1, 12)] + [("h", "a", "xx"), ("h", "b", "x")], "g string, id string, body string")
    got = picks.spread_by_length(rows, "g", 4).collect()
    assert sorted(len(r.body) for r in got if r.g == "g") == [1, 4, 8, 11] and sum(r.g == "h" for r in got) == 2
    assert {r.g: r.median for r in picks.upper_median(rows.withColumn("n", F.length("body")), "g", "n").collect()} == {"g": 6, "h": 2}
    assert [r.id for r in picks.verbatim(rows.filter("g = 'g'"), "g", 3, 2).orderBy("rank").collect()] == ["i06", "i05", "i07"]


def test_history_view():
    assert picks.visible(0, 3, 2, 42, "p", 0) == [] and picks.visible(5, 3, 2, 42, "p", 5) == [0, 1, 2, 3, 4]
    some = picks.visible(20, 3, 2, 42, "p", 20)
    old = sorted(random.Random("42:p:20").sample(list(range(17)), 2))
    assert some == old + [17, 18, 19] and some == picks.visible(20, 3, 2, 42, "p", 20)


def test_lookups(spark):
    posts = frame(spark, [("a",), ("b",)], "post_id string")
    found, missing = picks.wanted(posts, frame(spark, [("a",), ("a",), ("z",)], "post_id string"), "post_id")
    assert [r.post_id for r in found.collect()] == ["a"] and [r.post_id for r in missing.collect()] == ["z"]
    sets = frame(spark, [("p", "x"), ("p", "y"), ("q", "x")], "g string, m string")
    assert {r.g: (r.n_missing, r.complete) for r in picks.all_in(sets, "g", "m", frame(spark, [("x",)], "m string")).collect()} == {"p": (1, False), "q": (0, True)}
    cards = frame(spark, [("a", "s", "1", None), ("b", "s", None, None), ("c", "t", "3", "")], "author string, source string, card string, error string")
    reused = frame(spark, [("b", "s", "4", ""), ("d", "s", "5", "bad")], "author string, source string, card string, error string")
    got = picks.preferred(frame(spark, [(x,) for x in "abcd"], "author string"), "author", cards, reused, "s")
    assert {r.author: (r.origin, r.card) for r in got.collect()} == {"a": ("existing", "1"), "b": ("reused", "4"), "c": ("new", None), "d": ("new", None)}
    hist = frame(spark, [("x", None), ("x", "p"), ("x", "q")], "author string, post_id string")
    assert picks.not_blocked(hist, frame(spark, [("p",)], "post_id string")).count() == 2
    order = picks.preferred_first(frame(spark, [("a",), ("b",), ("c",)], "k string"), "k", frame(spark, [("c",)], "k string"))
    assert [r.k for r in order.orderBy("place").collect()] == ["c", "a", "b"]


def test_texts(spark):
    df = frame(spark, [("  a b  c ", " T ", " \n"), ("abcdefgh ij", "", "S"), (None, None, None)], "t string, title string, s string")
    assert [r.x for r in df.select(clipped(F.col("t"), 4).alias("x")).collect()] == ["a b", "abcd", ""]
    assert [r.x for r in df.select(post_text(F.col("title"), F.col("s")).alias("x")).collect()] == ["T", "\n\nS", ""]
    bad = frame(spark, [("[ Removed ]",), ("[removed by moderator]",), ("  ",), (None,), ("fine",)], "t string")
    assert [r.x for r in bad.select(unusable(F.col("t")).alias("x")).collect()] == [True, True, True, True, False]


def test_large_posts_are_linearised_alike(spark):
    rnd = random.Random(1)
    rows = []
    for p in "pq":
        for k in range(60):
            up = rnd.choice([None, p, "gone", *[f"{p}{j}" for j in range(60)]]) if k > 3 else None
            rows.append((p, f"{p}{k}", up, rnd.random() < 0.1, float(rnd.randint(0, 9)), "text"))
    df = frame(spark, rows, "post_id string, id string, parent_id string, to_post boolean, created_utc double, body string").repartition(3)
    got = [{(r.post_id, r.id): r.pos for r in linearise(df, limit).collect()} for limit in (10**6, 10)]
    assert got[0] == got[1] and len(got[0]) == 120 and linearise(df.limit(0)).count() == 0


def test_chi_square(spark):
    assert abs(stats.upper_gamma(8.0, 19.9139 / 2) - 0.2244) < 1e-3 and abs(stats.upper_gamma(0.5, 3.841458821 / 2) - 0.05) < 1e-9
    assert stats.upper_gamma(3.0, 0.0) == 1.0
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5 + [(None, "x"), ("b", None)]
    df = frame(spark, rows, "r string, c string")
    t = stats.independence(df, "r", "c").first()
    o = np.array([[10, 20], [30, 5]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    chi2 = ((o - e) ** 2 / e).sum()
    assert abs(t.chi2 - chi2) < 1e-9 and t.dof == 1 and t.n == 65 and abs(t.cramers_v - np.sqrt(chi2 / 65)) < 1e-9 and t.p < 1e-4
    assert stats.independence(df.limit(0), "r", "c").first().verdict == "too_sparse"
    cells = {(r.r, r.c): r for r in stats.association(df, "r", "c", ["x", "y", "never"]).collect()}
    assert len(cells) == 6 and cells[("a", "never")]["count"] == 0 and cells[("a", "never")].residual == 0.0
    assert abs(cells[("a", "x")].residual - (10 - e[0, 0]) / np.sqrt(e[0, 0])) < 1e-9 and cells[("b", "x")].flag and not cells[("a", "never")].flag


def test_bh_in_blocks(spark):
    df = frame(spark, [(k, p) for k, p in enumerate([0.01, 0.04, 0.03, 0.2])], "k long, p double")
    assert [round(r.q, 6) for r in stats.bh(df, "p", [F.col("k")]).orderBy("k").collect()] == [0.04, 0.053333, 0.053333, 0.2]
    rnd = np.random.default_rng(2)
    p = rnd.random(200) ** 2
    order = np.argsort(p)
    want = np.empty(200)
    want[order] = np.minimum(1, np.minimum.accumulate((p[order] * 200 / np.arange(1, 201))[::-1])[::-1])
    got = stats.bh(frame(spark, [(k, float(v)) for k, v in enumerate(p)], "k long, p double"), "p", [F.col("k")], block=7).orderBy("k").collect()
    assert np.allclose([r.q for r in got], want)


def two_groups(n=40, dim=6, seed=0):
    rnd = np.random.default_rng(seed)
    x = np.eye(dim)[np.arange(n) % 3] + 0.15 * rnd.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plain_silhouette(x, labels):
    d = 1 - x @ x.T
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() < 2:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_topics(spark):
    x = two_groups()
    df = frame(spark, [(k, [float(v) for v in e]) for k, e in enumerate(x)], "thread_id long, e array<double>")
    found, search = topics.choose_spherical(df, "thread_id", 2, 4, 3)
    got = {r.thread_id: r.cluster for r in found.collect()}
    labels = np.array([got[k] for k in range(40)])
    best = max(s["silhouette"] for s in search)
    assert abs(best - plain_silhouette(x, labels)) < 1e-9 and len(set(labels)) == 3
    assert all(len(set(labels[np.arange(40) % 3 == g])) == 1 for g in range(3))
    linked, search = topics.choose_linkage(df, "thread_id", 2, 5)
    again = {r.thread_id: r.cluster for r in linked.collect()}
    assert len(set(again.values())) == 3 and abs(max(s["silhouette"] for s in search) - best) < 1e-9
    titled = df.withColumn("title", F.when(F.col("thread_id") == 5, "[deleted]").otherwise(F.concat(F.lit("t"), "thread_id")))
    named, _ = topics.topics(titled, low=2, high=4, least=3)
    by = {r.thread_id: r.cluster_id for r in named.collect()}
    assert by[5] == "unusable" and len(by) == 40
    same = titled.withColumn("title", F.lit("one"))
    assert {r.cluster_id for r in topics.topics(same)[0].collect()} == {"1"}
    with pytest.raises(ValueError):
        topics.topics(titled, "other")


def test_small_clusters_join_the_most_similar():
    s = np.array([[10.0, 0], [0, 8.0], [1.9, 0.2], [0.1, 1.0]])
    assert topics.merge_small(np.array([10, 8, 2, 1]), s, 3).tolist() == [1, 2, 1, 2]
    assert topics.merge_small(np.array([1, 1, 0]), np.eye(3), 9).tolist() == [1, 2, 0]


def test_keywords(spark):
    df = frame(spark, [("a", "g", "The red kettle leaks"), ("b", "g", "red kettle 2024"), ("c", "h", "Größe zählt"), ("d", "h", None)], "thread_id string, title string, s string")
    df = df.withColumnRenamed("title", "x").withColumnRenamed("s", "title").withColumnRenamed("x", "g")
    got = {(r.g, r.term) for r in topics.keywords(df, "g").collect()}
    assert ("g", "red kettle") in got and ("h", "größe") in got and not any(t in ("the", "2024") for _, t in got)


def test_descriptions(spark):
    df = frame(spark, [("a", 1.0), ("a", 2.0), ("a", float("nan")), ("a", 4.0), ("b", None)], "g string, x double")
    got = {r.g: r for r in describe.describe(df, "g", "x").collect()}
    assert (got["a"].n, got["a"].median, got["a"].least, got["a"].most) == (3, 2.0, 1.0, 4.0) and abs(got["a"].sd - np.std([1, 2, 4], ddof=1)) < 1e-12
    assert got["b"].n == 0 and got["b"].median is None
    two = frame(spark, [("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", 2.0, 2.0), ("b", 6.0, 2.0)], "g string, x double, y double")
    d = {r.metric: r.d for r in describe.cohens_d(two, "g", "b", "a", ["x", "y"]).collect()}
    assert abs(d["x"] - 2 / np.sqrt((2 + 8) / 2)) < 1e-12 and d["y"] == 0.0
    assert {r.column: r.r for r in describe.correlations(two, ["x", "y"], "x").collect()}["y"] is None
    cut = describe.slices(frame(spark, [("a", None), ("b", "x")], "g string, h string"), ["g", "h"], {"n": F.count("*")})
    assert sorted((r.level, r.n) for r in cut.collect()) == [("", 2), ("g", 1), ("g", 1), ("g+h", 1), ("g+h", 1), ("h", 1), ("h", 1)]


def test_cards_and_prompts(spark):
    assert personas.card_fields('Sure: {"stance": " a ", "tone": 2} more {"x": 1}') == {"stance": "a", "tone": "2", "quirks": ""}
    assert personas.card_fields('{"stance": "a", } or {bad}') is None and personas.card_fields(None) is None and personas.card_fields("[1]") is None
    budget = frame(spark, [(10,), (700,), (90000,)], "p long").select(personas.token_budget(F.col("p"), 3.5, 80, 400).alias("n"))
    assert [r.n for r in budget.collect()] == [80, 260, 400]
    t = frame(spark, [("a", "p", "i1", 0, "short", "s", 1.0), ("a", "q", "i2", 0, "a longer comment", None, 2.0)], "author string, post_id string, id string, pos long, body string, subreddit string, created_utc double")
    prompt = personas.card_prompts(t, 5, 9).first().prompt
    assert "Comments: 2 in 2 communities (r/s x1, r/ x1)" in prompt and "[1] short\n[2] a lo\n" in prompt
    shown = F.array(F.struct(F.lit(0).alias("place"), F.lit("Agent-1").alias("alias"), F.lit("hi").alias("body")))
    text = spark.range(1).select(personas.turn_prompt(F.lit(" T "), F.lit(""), shown, F.lit(80)).alias("x")).first().x
    assert text == "Title: T\n\nSo far:\n[1] Agent-1: hi\n\nWrite your comment. About 80 characters."


def test_simulation(spark):
    cfg = personas.Simulation(n_agents=2, structure="weak_tree", reply_share=1.0)
    posts = frame(spark, [("p", "T", None), ("p", "T", None)], "post_id string, title string, selftext string")
    got = personas.simulate(posts, cfg, lambda prompt, agent, k: f"{agent} says {k}", F.lit(4)).orderBy("created_order").collect()
    assert [r.agent for r in got] == ["Agent-1", "Agent-2"] * 2 and got[0].parent_id is None and got[3].parent_id.split("#")[0].startswith("Agent")
    assert sorted(personas.speakers(3, 3, "random", 1)) == ["Agent-1", "Agent-2", "Agent-3"]
    with pytest.raises(ValueError):
        personas.Simulation(order="never")
    arms = [{"name": f"{t}{k}", "tier": t, "model": "m"} for t in ("low", "mid", "high") for k in range(2)]
    personas.check_arms(arms)
    for bad in (arms[:5], [*arms[:5], {**arms[5], "tier": "low"}], [*arms[:5], arms[0]], [*arms[:5], {**arms[5], "model": ""}]):
        with pytest.raises(ValueError):
            personas.check_arms(bad)
