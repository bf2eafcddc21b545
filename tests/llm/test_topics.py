import numpy as np

from skein.llm import topics
from skein.llm.topics import _maximise, _start, _sums, clusters, split_title
from skein.llm.topics_queries import p7_groups

SAY = {"leak": ["water drips below", "puddle underneath", "leaking at the base"], "noise": ["loud rattle", "noisy start", "strange hum"]}
FRAME = ["Help with the {x}, {s}", "{x}: {s}", "Is {s} normal for the {x}?"]


def test_paraphrases_land_together(spark):
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for thing in range(80):
        kind = ["leak", "noise"][thing % 2]
        for k in range(3):
            key = f"t{thing:03d}-{k}"
            said = SAY[kind][rng.integers(3)]
            rows.append((key, FRAME[rng.integers(3)].format(x=f"Zor{chr(97 + thing % 26)}{chr(97 + thing // 26)}x {100 + thing}", s=said)))
            truth[key] = (thing, kind)
    rows += [("none", None), ("bare", "Just words"), ("empty", "")]
    df = spark.createDataFrame(rows, "id string, title string")
    got = {r.k: r for r in clusters(df, "id", "title").collect()}
    assert "none" not in got and got["bare"].thing is None
    same = [(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]]
    hit = [(a, b) for a, b in same if got[a].thing == got[b].thing and got[a].question == got[b].question]
    assert len(hit) >= 0.9 * len(same)
    leak = {got[k].question for k, (_, kind) in truth.items() if kind == "leak"}
    noise = {got[k].question for k, (_, kind) in truth.items() if kind == "noise"}
    assert not leak & noise
    assert clusters(df.limit(0), "id", "title").count() == 0


def test_thing(spark):
    df = spark.createDataFrame([("a", "Help with the Zorax-950, a leak"), ("b", "ZORAX950 (950) owners"), ("c", "zorax (950) again")], "id string, title string")
    assert {r.thing for r in split_title(df, "id", "title").collect()} == {"zorax 950"}


def test_mixture_improves():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.2, (50, 3)) for m in (-2, 0, 2)])
    model = _start(x, 3, rng)
    last = -np.inf
    for _ in range(5):
        *parts, total = _sums(model, x)
        assert total >= last - 1.0
        last, model = total, _maximise(*parts)
    assert np.allclose(model.weights.sum(), 1) and len(set(model.log_joint(x).argmax(1)[::50])) == 3


def test_every_wording_counts_in_the_fit(spark):
    # some wordings hold most rows; rare ones must still get components of their own
    say = {"common": ["water drips below", "puddle underneath"], "rattle": ["loud rattle", "noisy start"], "price": ["resale value", "fair price"], "paint": ["chipped paint", "faded colour"]}
    rows, kind_of = [], {}
    for kind, (times, things) in {"common": (100, 90), "rattle": (2, 40), "price": (2, 40), "paint": (2, 40)}.items():
        for thing in range(things):
            for k in range(times):
                key = f"{kind}-{thing:02d}-{k:03d}"
                rows.append((key, f"{kind}x {100 + thing}: {say[kind][k % 2]}"))
                kind_of[key] = kind
    got = clusters(spark.createDataFrame(rows, "id string, title string"), "id", "title").select("k", "question").collect()
    questions = {kind: {r.question for r in got if kind_of[r.k] == kind} for kind in say}
    assert all(not questions[a] & questions[b] for a in say for b in say if a < b)


def test_titles_without_known_words_group_by_their_words(spark):
    rows = [("a", "Zorax 100: xylo quark"), ("b", "quark xylo Zorax 100"), ("c", "Zorax 100: other"), ("d", "Zorax 100"), ("e", "Zorax 100")]
    got = {r.k: r.question for r in clusters(spark.createDataFrame(rows, "id string, title string"), "id", "title").collect()}
    assert got["a"] == got["b"] and got["a"] != got["c"] and got["d"] is None


def test_sizes_grow_while_the_criterion_falls(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(30, topics.DIMENSIONS)) * 6
    x = [(1, (centres[k % 30] + 0.1 * rnd.normal(size=topics.DIMENSIONS)).tolist()) for k in range(900)]
    monkeypatch.setattr(topics, "SIZES", (4, 8))
    rows = spark.createDataFrame(x, "c long, x array<double>")
    read = lambda b: b.column(b.num_columns - 1).flatten().to_numpy().reshape(-1, topics.DIMENSIONS)
    assert len(topics.fit_rows(rows, read, 900).means) >= 27


def test_every_title_is_in_a_group(spark, tmp_path):
    titles = [f"Zor{chr(97 + t)}x {100 + t}: {say}" for t in range(24) for say in SAY[["leak", "noise"][t % 2]]]
    odd = {
        "asked": ["Water drips below the kettle", "KETTLE the - below, drips water!"], "other": ["Water drips below the lamp"],
        "rare": ["Quark xylo", "xylo: quark?"], "thing": ["Zorax 100", "zorax-100!"], "signs": ["?!  42", " ?! 42"], "more signs": ["?! 43"], "blank": [""],
    }
    kind_of = {t: kind for kind, some in odd.items() for t in some}
    rows = [(f"p{k:03d}", t, "here") for k, t in enumerate([*titles, *kind_of])] + [("null", None, "here")]
    spark.createDataFrame(rows, "post_id string, title string, subreddit string").write.parquet(f"{tmp_path}/threads.parquet")
    got = p7_groups(spark, str(tmp_path)).collect()
    assert sum(r["size"] for r in got) == len(rows) - 1
    for kind, some in odd.items():
        groups = [r for r in got if kind_of.get(r.typical.split(" | ")[0]) == kind]
        assert [r["size"] for r in groups] == [len(some)], kind
