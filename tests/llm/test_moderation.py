import numpy as np

from skein.llm.moderation import CASE_RADIUS, RADIUS, Index, calibrated, fit, monotone, score, undisguise

NICE = ["the pump hums at night", "a red bike needs new tyres", "we moved the old kettle", "my sister likes the garden"]
RUDE = ["you are a worthless idiot", "shut up you stupid moron", "go away you filthy rat", "you stupid worthless rat"]


def test_undisguise():
    starred = {"f*lthy": "filthy"}
    for disguised, plain in [("m o r o n", "moron"), ("mo.ron", "moron"), ("1d10t", "idiot"), ("moooron", "moron"), ("f*lthy", "filthy")]:
        assert undisguise(disguised, starred) == plain
    assert undisguise("call 555 at 10", {}) == "call 555 at 10"


def test_nearest_is_exact():
    rnd = np.random.default_rng(1)
    words = [f"w{k}" for k in "abcdefghijklmnopqrstuvwx"]
    docs = sorted({tuple(rnd.choice(words, rnd.integers(2, 7))) for _ in range(300)})
    index = Index(docs, np.array([k % 3 == 0 for k in range(len(docs))], float), [1] * len(docs))
    full = np.zeros((len(docs), len(index.vocab)))
    for k, d in enumerate(index.docs):
        ids, w = index.vector(d)
        full[k, ids] = w
    for q in docs[::17]:
        ids, w = index.vector(q)
        dense = np.zeros(len(index.vocab))
        dense[ids] = w
        cos = full @ dense
        got = index.nearest(ids, w)
        tenth = np.sort(cos)[-10]
        want = {k for k in np.flatnonzero(cos >= max(tenth - 1e-6, RADIUS))}
        assert {k for _, k in got} == want
        any_case = (cos[index.cases > 0] >= CASE_RADIUS + 1e-6).any()
        if any_case:
            assert index.may_be_case(np.array([0, len(ids)]), ids, w)[0]


def test_held_out():
    texts = [f"{a}. {b}." for a in NICE for b in NICE] + [f"{NICE[k % 4]}. {r}." for k, r in enumerate(RUDE * 3)]
    index, steps = fit(texts, [0.0] * 16 + [3.0] * 12)
    for text, bad in [("you worthless stupid moron", True), ("the old red bike hums", False)]:
        ids, w = index.vector(index.tokens(text))
        assert (calibrated(index.vote(index.nearest(ids, w)), steps) >= 0.5) == bad


def test_monotone():
    steps = monotone([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1)], 4, 2)
    assert [p for _, p in steps] == sorted(p for _, p in steps)


def test_calibration_takes_all_records():
    # cases come first, as the keys of one table do: 1,800 of 2,400 records of one text are cases
    texts = ["you stupid rusty kettle"] * 1800 + [NICE[0]] * 600 + ["you stupid rusty kettle"] * 600
    index, steps = fit(texts, [3.0] * 1800 + [0.0] * 1200)
    vote = index.vote(index.nearest(*index.vector(index.tokens(texts[0]))))
    assert abs(calibrated(vote, steps) - 0.75) < 0.01
    assert [p for _, p in monotone([(0.5, 1)] * 10 + [(0.5, 0)] * 10, 60, 40)] == [2 / 3]


def test_case_among_unseen_words_scores():
    index, _ = fit([f"{a}. {b}." for a in NICE for b in NICE] + RUDE * 3, [0.0] * 16 + [3.0] * 12)
    for unseen in range(8, 20):
        ids, w = index.vector(["you", "stupid", "worthless", "rat", *(f"new{chr(97 + k)}" for k in range(unseen))])
        found = index.nearest(ids, w)
        seen = bool(found) and RADIUS <= found[0][0] < 0.5
        if seen:
            assert index.may_be_case(np.array([0, len(ids)]), ids, w)[0] and index.vote(found) > 0
            break
    assert seen


def test_tables(spark):
    texts = spark.createDataFrame(
        [("a", "The pump hums at night."), ("b", "You are a w0rthless id.iot!"), ("c", None), ("d", ""), ("e", NICE[1])]
        + [(f"n{k}", n) for k, n in enumerate(NICE * 3)] + [(f"r{k}", r + ". " + NICE[k]) for k, r in enumerate(RUDE)],
        "k string, text string",
    )
    labels = spark.createDataFrame(
        [(f"n{k}", "x", 0) for k in range(12)] + [(f"r{k}", "x", 3) for k in range(4)] * 2, "k string, rater string, rating int"
    )
    got = {r.k: r for r in score(texts, labels).collect()}
    assert len(got) == 21 and got["b"].score > 0.5 and got["b"].evidence
    assert max(got[k].score for k in "acde") < 0.5
    assert score(texts.limit(0), labels).count() == 0
    assert {r.score for r in score(texts, labels.limit(0)).collect()} == {0.0}
