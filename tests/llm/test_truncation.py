import random

from skein.llm.truncation import detect, ending, words

PARTS = ["the old kettle", "a red bike", "my neighbour", "our garden gate"], ["makes a strange noise", "needs another look", "was repaired twice"], ["after the winter.", "since the flood.", "in the morning."]


def sentence(rnd):
    return " ".join(rnd.choice(p) for p in PARTS).capitalize()


def test_ending():
    assert [ending(t)[1] for t in ("done.", "so...", "so […]", "na�", "first,", "lol", "see https://x.example/t", "ok 👍", "")] == [
        "", "mark", "explicit", "broken", "comma", "plain", "", "", "",
    ]
    assert words("One 2 three. Four") == (["one", "0", "three", "four"], ["w", "w", "e", "x"])


def test_planted_cuts(spark):
    rnd = random.Random(2)
    rows, cut = [], set()
    for k in range(900):
        text = " ".join(sentence(rnd) for _ in range(3))
        kind = k % 6
        if kind == 1:
            text, _ = text[: len(text) - 12], cut.add(str(k))  # within the last words
        elif kind == 2:
            text += " lol"
        elif kind == 3:
            text = text[:-1]
        elif kind == 4:
            text = text[:-1] + "…"
        rows.append((str(k), "m", text))
    rows += [("n", None, None), ("e", "m", ""), ("b", None, "  ")]
    df = spark.createDataFrame(rows, "k string, source string, text string")
    got = {r.k for r in detect(df).collect() if r.truncated}
    assert len(cut - got) <= 3 and len(got - cut) <= 3
    assert detect(df.limit(0)).count() == 0
