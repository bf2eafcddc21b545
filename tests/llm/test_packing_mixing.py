import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.llm.mixing import capped_mean, mix, report, thresholds
from skein.llm.packing import _best_fit, containers, cost, pack, plan
from skein.llm.ranks import rank_within
from skein.llm.tokens import TOKENIZERS, VOCABULARY, count, encoding, with_tokens


def one_by_one(sizes, capacities):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b >= s]
        if fits:
            b = min(fits)
            bins.remove(b)
        else:
            b = min(c for c in capacities if c >= s)
        bins.append(b - s)
    return Counter(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_item_by_item(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randint(1, 40), rnd.randint(1, 8), 7]) for _ in range(300)]
    histogram = Counter(sizes)
    room = {}
    seen = Counter()
    for size, a, b, per, first in _best_fit(histogram, [16, 40], False):
        for r in range(a, b):
            room.setdefault(first + (r - a) // per, []).append(size)
            seen[size] += 1
    assert seen == histogram
    used = Counter(sum(x) for x in room.values())
    assert sum(n for n in used.values()) == sum(one_by_one(sizes, [16, 40]).values())
    assert max(used) <= 40


@pytest.mark.parametrize("seed", range(6))
def test_joint_plan_is_whole_and_never_dearer(seed):
    rnd = random.Random(seed)
    histogram = Counter(rnd.choice([rnd.randint(1, 40), 9, 21]) for _ in range(400))
    slots = plan(histogram, [16, 24, 40])
    seen, room = Counter(), Counter()
    for size, a, b, per, first in slots:
        seen[size] += b - a
        for r in range(a, b):
            room[first + (r - a) // per] += size
    assert seen == histogram and max(room.values()) <= 40
    fits = lambda n: next(c for c in (16, 24, 40) if c >= n)
    assert abs(cost(slots, [16, 24, 40]) - sum(fits(n) + 0.016 for n in room.values())) < 1e-6
    assert cost(slots, [16, 24, 40]) <= cost(_best_fit(histogram, [16, 24, 40], False), [16, 24, 40])


def test_plan_prefers_the_capacity_that_wastes_less():
    # 9 fits 16 alone with 7 unused, 40 four times with 4 unused
    slots = plan({9: 400}, [16, 40])
    assert cost(slots, [16, 40]) < cost(_best_fit({9: 400}, [16, 40], False), [16, 40])


def test_pack(spark):
    rows = [(k, (k * 37) % 23) for k in range(400)] + [(900, 130), (901, None), (902, 0), (903, 5), (903, 5)]
    df = spark.createDataFrame(rows, "id long, size long").withColumns({"n": F.lit("clash"), "piece": F.lit(7), "rank": F.lit(1)})
    got = pack(df, "id", "size", [20, 50]).collect()
    assert sum(r.n for r in got) == sum(s or 0 for _, s in rows)
    assert {r.id for r in got if r.n_pieces > 1} == {900}
    full = Counter()
    for r in got:
        full[r.container_id] += r.n
    assert max(full.values()) <= 50 and sorted(r.piece for r in got if r.id == 900) == [0, 1, 2]
    caps = containers(pack(df, "id", "size", [20, 50]), [20, 50]).collect()
    assert all(r.used <= r.capacity and (r.capacity == 20) == (r.used <= 20) for r in caps)
    assert pack(df.limit(0), "id", "size", [20]).count() == 0


def test_rank_within_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 5).alias("g"))
    got = rank_within(df, "g", ["id"]).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in got)


def test_mixture(spark):
    rows = [(k, "abc"[k % 7 % 3], 50 + k % 100) for k in range(3000)] + [(9001, None, 5), (9002, "zz", 5), (9003, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    docs = docs.withColumns({"goal": F.lit("clash"), "steps": F.lit(1), "uses": F.lit(None), "copy": F.lit(0)})
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.15, 1), ("gone", 0.05, 3)], "source string, target_share double, max_repeats int")
    mixture = mix(docs, targets)
    got = {r.source: r for r in report(docs, mixture, targets).collect()}
    for s, share in (("a", 0.5 / 0.95), ("b", 0.3 / 0.95), ("c", 0.15 / 0.95)):
        assert abs(got[s].actual_share - share) < 0.01 and got[s].most_uses <= got[s].max_repeats
    assert got["gone"].tokens == 0
    keys = [r.order_key for r in mixture.collect()]
    assert keys == sorted(keys)
    assert mix(docs.limit(0), targets).count() == 0 and mix(docs, targets.limit(0)).count() == 0


def test_capped_poisson():
    for rate, cap in ((0.3, 1), (1.5, 4), (6.0, 8)):
        steps = thresholds(rate, cap)
        mean = sum(1 - t for t in steps)
        assert abs(mean - rate) < 1e-6 and steps == sorted(steps)
    assert abs(capped_mean(2.0, 50) - 2.0) < 1e-9


def test_tokens(spark):
    path = f"{TOKENIZERS}/{VOCABULARY}"
    text = "Hello world, this is a test. " * 20000
    assert count(text, path) == len(encoding(path).encode_ordinary(text))
    odd = "ab  c1 \n" * 30000 + "x" * 1500 + " y z " * 20000
    assert count(odd, path) == len(encoding(path).encode_ordinary(odd))
    df = spark.createDataFrame([(1, "two words"), (2, None), (3, ""), (4, "two words")], "id long, t string")
    assert {r.id: r.n_tokens for r in with_tokens(df, "id", "t").collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
