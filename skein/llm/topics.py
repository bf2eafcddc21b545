"""Records in clusters of mutual similarity, by a Gaussian mixture.

A title names a thing (a name with a number) and says something about it. What is said gets
features from how words are used across things: words that different titles of one thing share
the thing with, weighted by positive pointwise mutual information and reduced by an eigen-
decomposition. A Gaussian mixture, its covariances regularised and its size grown until the
Bayesian information criterion stops falling, divides the standardised features; the members of
highest density stand for their cluster. Counts, features, the start of the mixture, its rounds and
its size cover all rows, as distinct vectors with their counts. A title none of whose words has
features makes a cluster with the titles of exactly the same words. Of titles that name no thing,
the words without features stand for it: those of one cluster share them too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import cut, release

#: Words that get features: the most frequent ones, at least this frequent.
MAX_WORDS, MIN_COUNT = 2_000, 4
#: Dimensions kept, the sizes tried first, and the factor by which they grow while that helps.
DIMENSIONS, SIZES, GROWTH = 24, (8, 16, 32, 64, 96), 1.5
#: Rounds that look for vectors far from those found so far, and vectors found in each.
START_ROUNDS, START_ROWS = 5, 800
#: Added to the diagonal of every covariance; rounds of each size and more of the best one.
RIDGE, ROUNDS, LAST_ROUNDS = 0.05, 12, 3
#: Two components say the same in other words if, of two titles of one thing, one in each is about
#: as likely as both in one: this many things at least, and this share of the geometric mean.
MEET, MEET_SHARE = 3, 0.6
#: Votes a component counts with at least that hardly ever meets itself.
RARE = 0.25
SEED = 7

_THING = r"(?i)(\p{L}{3,})[\s\-(]{0,2}(\d{2,5})\)?"


def split_title(titles: DataFrame, key: str, title: str) -> DataFrame:
    """(k, thing, said): the name and number in lower case, null without one, and the words said."""
    t = F.col(title)
    name, number = F.lower(F.regexp_extract(t, _THING, 1)), F.regexp_extract(t, _THING, 2)
    rest = F.regexp_replace(F.lower(F.regexp_replace(t, _THING, " ")), r"[^\p{L}']+", " ")
    words = F.array_distinct(F.filter(F.split(rest, " "), lambda w: F.length(w) > 0))
    return titles.filter(t.isNotNull()).select(
        F.col(key).alias("k"), F.when(name != "", F.concat_ws(" ", name, number)).alias("thing"), words.alias("said")
    )


def word_vectors(rows: DataFrame) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(word -> row, vectors, frequency) from what the titles of each thing share.

    Two words go together as often as two different titles of one thing use them. A thing counts
    with the logarithm of its titles, so no single thing decides.
    """
    long = rows.select("k", "thing", F.explode("said").alias("w"))
    df = long.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)
    top = df.orderBy(F.desc("n"), "w").limit(MAX_WORDS).collect()  # bounded by MAX_WORDS
    vocab = {r["w"]: k for k, r in enumerate(top)}
    total = rows.count() or 1
    freq = np.array([r["n"] / total for r in top])
    if not vocab:
        return vocab, np.zeros((0, DIMENSIONS)), freq
    per = long.filter(F.col("thing").isNotNull() & F.col("w").isin(list(vocab))).groupBy("thing", "w").agg(F.count("*").alias("c"))
    size = rows.filter("thing is not null").groupBy("thing").agg(F.count("*").alias("m")).filter("m > 1")
    per = cut(per.join(size, "thing"), "shared")
    # at most MAX_WORDS words per thing, so the self-join of a thing is bounded
    a, b = per.select("thing", "w", "c", "m"), per.select("thing", F.col("w").alias("v"), F.col("c").alias("d"))
    same = rows.join(size, "thing").select("thing", "m", "k", F.explode("said").alias("w"), F.col("said")).filter(F.col("w").isin(list(vocab)))
    same = same.select("thing", "m", "w", F.explode("said").alias("v")).filter(F.col("v").isin(list(vocab)))
    weight = F.log1p("m") / (F.col("m") * (F.col("m") - 1))
    both = a.join(b, "thing").groupBy("w", "v").agg(F.sum(F.col("c") * F.col("d") * weight).alias("x"))
    inside = same.groupBy("w", "v").agg(F.sum(weight).alias("y"))
    pairs = both.join(inside, ["w", "v"], "left").select("w", "v", (F.col("x") - F.coalesce("y", F.lit(0.0))).alias("x")).toArrow()
    release(per)
    co = np.zeros((len(vocab), len(vocab)))
    w = [vocab[x] for x in pairs.column("w").to_pylist()]
    v = [vocab[x] for x in pairs.column("v").to_pylist()]
    co[w, v] = np.maximum(0, pairs.column("x").to_numpy())
    side = co.sum(1)
    expected = np.outer(side, side) / max(1e-9, co.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log(co / (expected + 1e-9))
    # rare pairs say little: damped by their count
    ppmi = np.where(co > 0, np.maximum(0, pmi) * (co / (co + 1)), 0)
    values, vectors = np.linalg.eigh((ppmi + ppmi.T) / 2)
    keep = np.argsort(-values)[: min(DIMENSIONS, len(vocab))]
    out = np.zeros((len(vocab), DIMENSIONS))
    out[:, : len(keep)] = vectors[:, keep] * np.sqrt(np.maximum(0, values[keep]))
    sign = np.sign(out[np.abs(out).argmax(0), np.arange(DIMENSIONS)])
    return vocab, out * np.where(sign == 0, 1, sign), freq


def _features(vocab: dict[str, int], vectors: np.ndarray, freq: np.ndarray):
    weight = np.log(1 / np.maximum(freq, 1e-9))[:, None] * vectors
    # a vector that is nothing but rounding is none
    known = {w for w, k in vocab.items() if np.linalg.norm(vectors[k]) > 1e-9}

    def one(words: list[str]) -> np.ndarray:
        at = [vocab[w] for w in words if w in vocab]
        x = weight[at].sum(0) if at else np.zeros(vectors.shape[1])
        n = np.linalg.norm(x)
        return x / n if n > 1e-9 else 0 * x

    def bare(words: list[str]) -> list[str]:
        return sorted(w for w in words if w not in known)

    return one, bare


class Mixture:
    """Gaussian mixture with full, regularised covariances."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> None:
        self.weights, self.means = weights, means
        self.chol = np.linalg.cholesky(covs)
        self.inverse = np.stack([np.linalg.inv(c) for c in self.chol])
        self.log_det = np.log(np.diagonal(self.chol, axis1=1, axis2=2)).sum(1)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.means)))
        for k, mean in enumerate(self.means):
            z = (x - mean) @ self.inverse[k].T
            out[:, k] = -0.5 * (z * z).sum(1) - self.log_det[k]
        return out + np.log(self.weights + 1e-300) - 0.5 * x.shape[1] * math.log(2 * math.pi)

    def respond(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joint = self.log_joint(x)
        top = joint.max(1, keepdims=True)
        density = (top + np.log(np.exp(joint - top).sum(1, keepdims=True)))[:, 0]
        return np.exp(joint - density[:, None]), density


def _sums(model: Mixture, x: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Rows, sums and second moments of the components, and the log-likelihood; ``c`` counts rows."""
    r, density = model.respond(x)
    if c is not None:
        r, density = r * c[:, None], density * c
    second = np.stack([(x * r[:, [k]]).T @ x for k in range(r.shape[1])])
    return r.sum(0), r.T @ x, second, float(density.sum())


def _maximise(n: np.ndarray, first: np.ndarray, second: np.ndarray) -> Mixture:
    live = n > 1e-6
    n, first, second = n[live], first[live], second[live]
    means = first / n[:, None]
    covs = second / n[:, None, None] - means[:, :, None] * means[:, None, :]
    d = means.shape[1]
    # few members: drawn towards a ball, so a covariance never has more freedom than its data
    shrink = (d / (d + n))[:, None, None]
    ball = np.trace(covs, axis1=1, axis2=2)[:, None, None] / d * np.eye(d)
    return Mixture(n / n.sum(), means, (1 - shrink) * covs + shrink * ball + RIDGE * np.eye(d))


def _start(x: np.ndarray, k: int, rng: np.random.Generator, c: np.ndarray | None = None) -> Mixture:
    c = np.ones(len(x)) if c is None else c
    centres = [x[rng.choice(len(x), p=c / c.sum())]]
    dist = ((x - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        far = c * dist
        centres.append(x[rng.choice(len(x), p=far / far.sum() if far.sum() > 0 else None)])
        dist = np.minimum(dist, ((x - centres[-1]) ** 2).sum(1))
    means = np.array(centres)
    for _ in range(8):
        at = _nearest(x, means)[0]
        means = np.stack([np.average(x[at == j], 0, c[at == j]) if c[at == j].sum() > 0 else means[j] for j in range(k)])
    r = np.eye(k)[at] * c[:, None]
    return _maximise(r.sum(0) + 1e-3, r.T @ x + 1e-3 * means, np.stack([(x * r[:, [j]]).T @ x + 1e-3 * np.outer(means[j], means[j]) for j in range(k)]))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centre, squared distance to it) of each row."""
    at, dist, own = np.zeros(len(x), np.int64), np.zeros(len(x)), (centres**2).sum(1)
    for a in range(0, len(x), 1000):
        part = x[a : a + 1000]
        gap = own - 2 * part @ centres.T
        at[a : a + 1000] = near = gap.argmin(1)
        dist[a : a + 1000] = gap[np.arange(len(part)), near] + (part**2).sum(1)
    return at, np.maximum(0, dist)


def _totals(rows: DataFrame, parts_of) -> list[np.ndarray]:
    """Flat sums over all rows of the arrays that ``parts_of`` makes of a batch."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                parts = [np.asarray(p, "<f8").ravel() for p in parts_of(batch)]
                total = parts if total is None else [a + b for a, b in zip(total, parts)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[p.tobytes() for p in total]], pa.list_(pa.binary()))], ["parts"])

    # one row of fixed size per core
    few = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    sums = None
    for r in few.mapInArrow(step, "parts array<binary>").collect():
        part = [np.frombuffer(bytes(p)) for p in r["parts"]]
        sums = part if sums is None else [a + b for a, b in zip(sums, part)]
    return sums


def _spread_out(rows: DataFrame, read) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, rows each is the nearest one of): where the mixture can start.

    Every round draws among all rows, by their squared distance from what was drawn before; up to
    START_ROUNDS * START_ROWS distinct vectors come in whole. rows: c, x.
    """
    sc = rows.sparkSession.sparkContext
    table = lambda df: read(df.toArrow().combine_chunks().to_batches()[0])
    seen = table(rows.orderBy(F.desc("c"), F.xxhash64("x"), "x").limit(1))
    for r in range(START_ROUNDS):
        now = sc.broadcast(seen)

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    gap = _nearest(read(batch), now.value)[1]
                    at = np.flatnonzero(gap > 1e-9)
                    u = ((batch.column(1).to_numpy().view(np.uint64) >> np.uint64(11)) + 0.5) / 2.0**53
                    key = -np.log(u[at]) / (gap[at] * batch.column(0).to_numpy()[at])
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(2).take(pa.array(at))], ["key", "x"])

        drawn = rows.select("c", F.xxhash64("x", F.lit(r)).alias("h"), "x").mapInArrow(far, "key double, x array<double>")
        drawn = drawn.orderBy("key", "x").limit(START_ROWS).toArrow().combine_chunks()
        if not drawn.num_rows:
            break
        seen = np.concatenate([seen, read(drawn.to_batches()[0])])
    last = sc.broadcast(seen)
    count = _totals(rows, lambda b: [np.bincount(_nearest(read(b), last.value)[0], b.column(0).to_numpy(), len(last.value))])
    return seen, count[0]


def _improve(models: list[Mixture], rows: DataFrame, read, rounds: int) -> list[Mixture]:
    """Rounds of expectation and maximisation over all rows, of all models at once."""
    for _ in range(rounds):
        now = rows.sparkSession.sparkContext.broadcast(models)
        sums = _totals(rows, lambda b: [p for m in now.value for p in _sums(m, read(b), b.column(0).to_numpy())[:3]])
        d = models[0].means.shape[1]
        models = [_maximise(n, first.reshape(-1, d), second.reshape(-1, d, d)) for n, first, second in zip(*[iter(sums)] * 3)]
        now.unpersist()
    return models


def fit_rows(rows: DataFrame, read, n: int) -> Mixture:
    """The mixture of the size with the lowest Bayesian information criterion over all ``n`` rows.

    rows: c, x (distinct vectors and how many rows have them); ``read`` makes points of a batch.
    """
    x, c = _spread_out(rows, read)

    def tried(sizes: list[int]) -> list[tuple[float, Mixture]]:
        models = [_start(x, min(k, len(x)), np.random.default_rng(SEED), c) for k in sizes]
        models = _improve(models, rows, read, ROUNDS)
        now = rows.sparkSession.sparkContext.broadcast(models)
        fits = _totals(rows, lambda b: [[m.respond(read(b))[1] @ b.column(0).to_numpy()] for m in now.value])
        # charged for its mean, its weight and the one variance that the ridge and shrinking leave it at
        # least; the covariance's other freedom, which they damp, is not charged
        return [(-2 * float(t[0]) + len(m.means) * (x.shape[1] + 2) * math.log(n), m) for t, m in zip(fits, models)]

    most = min(len(x), max(SIZES[0], n // 4))
    sizes = [k for k in SIZES if k <= most] or [most]
    found = tried(sizes)
    while min(found, key=lambda f: f[0]) is found[-1] and round(sizes[-1] * GROWTH) <= most:
        sizes.append(round(sizes[-1] * GROWTH))
        found += tried(sizes[-1:])
    return _improve([min(found, key=lambda f: f[0])[1]], rows, read, LAST_ROUNDS)[0]


def _same_question(named: DataFrame) -> dict[int, int]:
    """Component -> the least component of those that say the same."""
    per = named.filter("thing is not null").groupBy("thing", "question").agg(F.count("*").alias("c"))
    many = per.groupBy("thing").agg(F.sum("c").alias("m")).filter("m > 1")
    per = per.join(many, "thing")
    other = per.select("thing", F.col("question").alias("other"), F.col("c").alias("d"))
    # a thing has at most as many rows as the mixture has components; each thing has one vote
    same = F.col("question") == F.col("other")
    pair = F.col("c") * F.when(same, F.col("d") - 1).otherwise(F.col("d")) / (F.col("m") * (F.col("m") - 1))
    both = per.join(other, "thing").groupBy("question", "other").agg(F.sum(pair).alias("x"), F.count("*").alias("n")).collect()
    own = {r["question"]: r["x"] for r in both if r["question"] == r["other"]}
    lead = {q: q for q in own}

    def find(q: int) -> int:
        while lead[q] != q:
            q = lead[q]
        return q

    for r in sorted(both, key=lambda r: (r["question"], r["other"])):
        a, b = r["question"], r["other"]
        if a < b and r["n"] >= MEET and r["x"] >= MEET_SHARE * math.sqrt(max(own[a], RARE) * max(own[b], RARE)):
            x, y = sorted((find(a), find(b)))
            lead[y] = x
    return {q: find(q) for q in lead}


def clusters(titles: DataFrame, key: str, title: str) -> DataFrame:
    """(k, thing, question, density): the thing a title is about and the cluster of what it says.

    Titles that are null have no row; without a thing ``thing`` is null and ``question`` names the
    words without features besides the cluster, without any word ``question`` is null. ``density``
    ranks the members of a cluster. Repeated titles count each time and land in one cluster; an
    empty table gives an empty result.
    """
    spark = titles.sparkSession
    rows = cut(split_title(titles, key, title), "titles")
    shared = spark.sparkContext.broadcast(word_vectors(rows))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, bare = _features(*shared.value)
        for batch in batches:
            said = batch.column(2).to_pylist()
            x = [one(w) for w in said]
            flat = pa.array([v.tolist() if np.any(v) else None for v in x], pa.list_(pa.float64()))
            other = ["" if t is not None else " ".join(bare(w)) for t, w in zip(batch.column(1).to_pylist(), said)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(other, pa.string()), flat], ["k", "thing", "said", "other", "x"])

    kind = rows.schema["k"].dataType.simpleString()
    data = cut(rows.mapInArrow(features, f"k {kind}, thing string, said array<string>, other string, x array<double>"), "features")
    # without features: one cluster for each set of words
    words = F.concat(F.lit("words:"), F.array_join(F.array_sort("said"), " "))
    rest = data.filter("x is null").select("k", "thing", F.when(F.size("said") > 0, words).alias("question"), F.lit(None).cast("double").alias("density"))
    known = data.filter("x is not null").select("x")
    n = known.count()
    if not n:
        return rest
    stats = known.select(*[F.col("x")[j].alias(f"x{j}") for j in range(DIMENSIONS)])
    row = stats.agg(*[F.avg(f"x{j}") for j in range(DIMENSIONS)], *[F.stddev_pop(f"x{j}") for j in range(DIMENSIONS)]).collect()[0]
    mean = np.array(row[:DIMENSIONS], float)
    spread = np.array(row[DIMENSIONS:], float)
    scale = np.where(spread > 1e-9, spread, 1.0)

    def read(batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column(batch.num_columns - 1).flatten().to_numpy()
        return (flat.reshape(-1, DIMENSIONS) - mean) / scale

    distinct = cut(known.groupBy("x").agg(F.count("*").alias("c")).select("c", "x"), "distinct")
    model = fit_rows(distinct, read, n)
    final = spark.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joint = final.value.log_joint(read(batch)) if batch.num_rows else np.zeros((0, 1))
            at = joint.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(at, pa.int32()), pa.array(joint.max(1))],
                ["k", "thing", "other", "question", "density"],
            )

    schema = f"k {kind}, thing string, other string, question int, density double"
    named = cut(data.filter("x is not null").select("k", "thing", "other", "x").mapInArrow(assign, schema), "assigned")
    one_of = spark.createDataFrame(list(_same_question(named).items()), "question int, one int")
    # as many rows as the mixture has components
    named = named.join(F.broadcast(one_of), "question", "left").select(
        "k", "thing", F.rtrim(F.concat_ws(" ", F.coalesce("one", "question"), "other")).alias("question"), "density"
    )
    return named.unionByName(rest)
