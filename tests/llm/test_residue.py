import random

import numpy as np

from skein.llm.residue import _bytes, _shape, _stretches, fit, mark

import pyarrow as pa

SUBJECTS = "the pump|my neighbour|our old kettle|a red bike|the small garden|their shop".split("|")
VERBS = "broke after|was sold with|needs|came back from|never liked|stands behind".split("|")
THINGS = "the long winter|a new filter|two spare wheels|the repair bench|an honest price|the gate".split("|")

RESIDUE = [
    "Error 502: Bad Gateway", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet elit.",
    "Dear {{customer}}, thanks for your message about ${topic}.", "Welcome to [[CITY]]!", "undefined",
    "Your session has expired. Please sign in again.", "Access denied. Your request was blocked.",
]
PROSE = [
    "I keep getting a 502 bad gateway on the shop page, is it just me or is it down for you too?",
    "Write `{{ user }}` in the file and the pump needs a new filter.",
    "The old kettle never liked the long winter, they say.",
]


def corpus():
    rnd = random.Random(5)
    say = lambda: f"{rnd.choice(SUBJECTS)} {rnd.choice(VERBS)} {rnd.choice(THINGS)}.".capitalize()
    rows = [" ".join(say() for _ in range(rnd.randint(1, 4))) for _ in range(800)]
    return rows + PROSE * 3, RESIDUE


def test_held_out(spark):
    prose, residue = corpus()
    texts = prose + residue + [residue[3] + " " + prose[0], None, "", "  "]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "id long, t string, kind string")
    got = {int(r.id): r for r in mark(df, "id", "t", fit(df, "t")).collect()}
    assert len(got) == len(texts)
    flagged = {texts[k] for k, r in got.items() if r.residue > 0}
    assert set(residue) <= flagged and residue[3] + " " + prose[0] in flagged
    assert not flagged & set(PROSE) and len(flagged & set(prose)) <= 2
    assert 0 < got[len(prose) + len(residue)].residue < 1
    long = spark.createDataFrame([(1, "The pump needs a new filter. " * 9000)], "id long, t string")
    assert mark(long, "id", "t", fit(df, "t")).collect()[0].residue == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, t string")
    assert mark(df, "id", "t", fit(df, "t")).count() == 0


def test_pieces():
    b, at = _bytes(pa.array(["Ab c. De", None, "x `q` y"]))
    assert bytes(b) == b"Ab c. De\n\nx  y\n" and list(at) == [0, 9, 10, 15]
    assert list(_stretches(b)) == [0, 5, 9, 10]
    s, run = _shape(np.frombuffer(b"{{first_name}} Ab", np.uint8))
    assert bytes(s) == b"{{a}} Aa" and run[-1] == 7
