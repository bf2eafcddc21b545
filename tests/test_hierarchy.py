import random

import pytest
from pyspark.sql import functions as F

from skein.operators.hierarchy import components, descendants, fullname_id, hierarchies

SCHEMA = "s string, n string, p string, path int"


def brute(rows):
    """Follow every parent link one at a time."""
    parent = {}
    for s, n, p, _ in rows:
        if n is not None:
            parent.setdefault((s, n), p)
    out = {}
    for s, n in parent:
        chain, x = [], n
        while x not in chain:
            chain.append(x)
            up = parent[(s, x)]
            if up is None or up == s or (s, up) not in parent:
                x = None
                break
            x = up
        if x is None:
            out[(s, n)] = (chain[::-1], len(chain) - 1, chain[-1], None)
        else:
            out[(s, n)] = (None, None, None, min(chain[chain.index(x):]))
    return out


def brute_pairs(rows):
    """Every pair of a node and one below it; nodes on circles take no part, those below circles do."""
    parent = {}
    for s, n, p, _ in rows:
        if n is not None:
            parent.setdefault((s, n), p)
    up = {(s, n): p if p != s and (s, p) in parent else None for (s, n), p in parent.items()}

    def chain(s, n):
        seen = [n]
        while up[(s, seen[-1])] is not None and up[(s, seen[-1])] not in seen:
            seen.append(up[(s, seen[-1])])
        return seen

    on = {(s, n) for s, n in up if up[(s, chain(s, n)[-1])] == n}
    out = set()
    for s, n in up:
        for k, a in enumerate(chain(s, n)):
            if (s, n) in on or (s, a) in on:
                break
            if k:
                out.add((s, a, n, k))
    return out


def random_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for s in ["a", "b", "c", None]:
        names = [f"{s}{k:02d}" for k in range(30)]
        for k, n in enumerate(names):
            p = rnd.choice([*names[: k + 1], *names[:3], None, "gone", s]) if rnd.random() < 0.9 else rnd.choice(names)
            rows += [(s, n, p, 1)] * rnd.choice([1, 1, 2])
    rnd.shuffle(rows)
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return hierarchies(df, F.col("s"), F.col("n"), F.col("p"), **kw)


@pytest.mark.parametrize("limit", [200_000, 5])
def test_against_brute_force(spark, limit):
    rows = random_rows(3) + [("a", None, "x", 1)]
    nodes = run(spark, rows, max_local_rows=limit)
    got = {(r.scope, r.id): (r.path, r.depth, r.root, r.cycle_id) for r in nodes.collect()}
    assert got == brute(rows)
    pairs = {(r.scope, r.id, r.descendant_id, r.distance) for r in descendants(nodes).collect()}
    assert pairs == brute_pairs(rows)


def test_deep_chain_and_descendants(spark):
    rows = [("a", f"{k:04d}", f"{k - 1:04d}" if k else None, 0) for k in range(700)]
    for limit in (10**6, 10):
        got = {r.id: (r.depth, r.n_descendants, len(r.path)) for r in run(spark, rows, max_local_rows=limit).collect()}
        assert got["0699"] == (699, 0, 700) and got["0000"] == (0, 699, 1)


def test_both_routes_count_descendants_alike(spark):
    rows = random_rows(3) + [("q", n, p, 0) for n, p in [("x", "y"), ("y", "x"), ("a", "y"), ("b", "a"), ("c", "b"), ("d", "a")]]
    rows = list({(s, n): (s, n, p, k) for s, n, p, k in rows}.values())  # one parent each
    counts = [{(r.scope, r.id): r.n_descendants for r in run(spark, rows, max_local_rows=limit).collect()} for limit in (10**6, 3)]
    assert counts[0] == counts[1]
    assert {k: v for k, v in counts[1].items() if k[0] == "q"} == {("q", n): v for n, v in zip("xyabcd", (6, 6, 3, 1, 0, 0))}


def test_routes_agree_on_differing_parents_and_without_paths(spark):
    rows = random_rows(5) + [("a", "a03", "a01", 0), ("a", "a03", "a02", 0), ("a", "a03", None, 0)]
    for paths, small in ((True, 12), (False, 3)):
        got = [sorted(str(tuple(r)) for r in run(spark, rows, max_local_rows=limit, paths=paths).collect()) for limit in (10**6, small)]
        assert got[0] == got[1]


def test_empty_and_self_link(spark):
    assert run(spark, []).count() == 0
    assert run(spark, [("a", "x", "x", 0)]).collect()[0].cycle_id == "x"


def test_full_names(spark):
    df = spark.createDataFrame([("t1_ab",), ("x_a_b",), ("ab",), (None,)], "c string")
    assert [r.x for r in df.select(fullname_id(F.col("c")).alias("x")).collect()] == ["ab", "a_b", "ab", None]


def test_components():
    assert sorted(map(sorted, components([-1, 0, 3, 2, -1]))) == [[0, 1], [2, 3], [4]]
