"""Topics of titles: spherical k-means or average linkage over vectors, keywords, weights by topic.

k-means runs over all rows of a table of any size: each round is one pass that sums the rows of
every cluster, for all numbers of clusters tried at once. The silhouette is exact and needs no
pairs: for unit vectors the mean cosine distance to a cluster follows from the sum of its members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.discussion import unusable
from skein.operators.motion import MOTIONS
from skein.session import cut

#: Rounds of k-means; all are run.
ROUNDS = 40
#: Distinct vectors that average linkage takes; it holds all their distances, and more are an error.
LINKAGE_MOST = 5_000
# English words that say nothing about a topic.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing "
    "down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more "
    "most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs "
    "them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with "
    "would you your yours yourself yourselves"
).split()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _sums(rows: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """k -> (members, sums) of the clusters that rows fall into."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # as many vectors as there are clusters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {k: np.zeros(len(c)) for k, c in shared.value.items()}
        s = {k: np.zeros_like(c) for k, c in shared.value.items()}
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(0))
            for k, c in shared.value.items():
                at = (x @ c.T).argmax(1)
                one = np.zeros((len(x), len(c)))
                one[np.arange(len(x)), at] = 1
                n[k] += one.sum(0)
                s[k] += one.T @ x
        out = [(k, j, n[k][j], s[k][j].tolist()) for k in n for j in range(len(n[k])) if n[k][j]]
        cols = list(zip(*out)) if out else [[]] * 4
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["k", "j", "n", "s"])

    parts = rows.select("e").mapInArrow(run, "k int, j int, n double, s array<double>")
    total = parts.groupBy("k", "j").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    out = {k: (np.zeros(len(c)), np.zeros_like(c)) for k, c in centres.items()}
    for r in total.collect():  # a row for each cluster
        out[r["k"]][0][r["j"]] = r["n"]
        out[r["k"]][1][r["j"]] = r["s"]
    shared.unpersist()
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def spherical_kmeans(rows: DataFrame, key: str, ks: list[int], seed: int = 42, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """k -> the centres that k-means by cosine ends with, before its last assignment; rows: key, e (unit).

    Starts are rows drawn by a seeded hash of their key, other ones for each k. A cluster without
    members starts anew from the next row of a reserve drawn in the same way. All rounds are run.
    """
    start = {}
    for k in ks:
        h = F.xxhash64(F.lit(seed), F.lit(k), F.col(key))
        drawn = [np.array(r["e"], float) for r in rows.orderBy(h, F.col(key)).select("e").limit(2 * k).collect()]
        if drawn:
            start[k] = (np.stack(drawn[:k]), drawn[k:] or drawn)
    centres = {k: c for k, (c, _) in start.items()}
    taken = dict.fromkeys(centres, 0)
    for _ in range(rounds - 1 if centres else 0):
        for k, (n, s) in _sums(rows, centres).items():
            moved = _unit(s)
            for j in np.flatnonzero(n == 0):
                moved[j] = start[k][1][taken[k] % len(start[k][1])]
                taken[k] += 1
            centres[k] = moved
    return centres


def merge_small(n: np.ndarray, s: np.ndarray, least: int) -> np.ndarray:
    """Cluster -> its name from 1 after clusters below ``least`` have joined the most similar one.

    The smallest joins first; two clusters are left at least. Clusters without members get 0.
    n: members of each cluster; s: sums of their unit vectors.
    """
    n, s = n.astype(float).copy(), s.astype(float).copy()
    to = np.arange(len(n))
    alive = list(np.flatnonzero(n > 0))
    while len(alive) > 2:
        small = min(alive, key=lambda j: (n[j], j))
        if n[small] >= least:
            break
        centre = _unit(s)
        others = [j for j in alive if j != small]
        target = others[int(np.argmax([centre[small] @ centre[j] for j in others]))]
        n[target] += n[small]
        s[target] += s[small]
        to[to == small] = target
        alive.remove(small)
    names = {j: k for k, j in enumerate(sorted(alive), 1)}
    return np.array([names.get(int(t), 0) for t in to])


def assigned(rows: DataFrame, centres: np.ndarray, names: np.ndarray) -> DataFrame:
    """Rows with cluster: the name of the nearest centre."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, names))
    at = rows.columns.index("e")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, name = shared.value
        for batch in batches:
            found = name[(_matrix(batch.column(at)) @ c.T).argmax(1)] if len(batch) else np.array([], int)
            yield batch.append_column("cluster", pa.array(found, pa.int64()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cluster", T.LongType())]))


def silhouette(rows: DataFrame, group: str = "cluster") -> float | None:
    """Mean cosine silhouette of all rows (lone members count 0); None of fewer than two clusters."""
    sums = rows.groupBy(group).agg(F.count("*").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("e"))).alias("s"))
    held = sorted((r[group], r["n"], r["s"]) for r in sums.collect())  # a row for each cluster
    if len(held) < 2:
        return None
    names, n, s = ({g: k for k, (g, _, _) in enumerate(held)}, np.array([h[1] for h in held], float), np.array([h[2] for h in held]))
    shared = rows.sparkSession.sparkContext.broadcast((names, n, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, s = shared.value
        total = count = 0.0
        for batch in batches:
            if not len(batch):
                continue
            x, at = _matrix(batch.column(1)), np.array([names[g] for g in batch.column(0).to_pylist()])
            far = n - x @ s.T  # sum of distances to each cluster
            own = far[np.arange(len(x)), at] / np.maximum(n[at] - 1, 1)
            far = far / n
            far[np.arange(len(x)), at] = np.inf
            other = far.min(1)
            v = (other - own) / np.maximum(np.maximum(own, other), 1e-12)
            total += float(np.where(n[at] > 1, v, 0.0).sum())
            count += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([count])], ["t", "c"])

    r = rows.select(group, "e").mapInArrow(run, "t double, c double").agg(F.sum("t"), F.sum("c")).first()
    return r[0] / r[1]


def choose_spherical(rows: DataFrame, key: str, low: int = 5, high: int = 12, least: int = 15, seed: int = 42) -> tuple[DataFrame, list[dict]]:
    """(rows with cluster from 1, the search): the number of clusters with the best silhouette.

    Each k from ``low`` to ``high`` (no more than rows / ``least``) is run and its small clusters are
    merged; of equals the fewest win. rows: key, e (unit vectors).
    """
    rows = cut(rows, "vectors")
    n = rows.count()
    top = max(low, min(high, max(low, n // max(least, 1))))
    centres = spherical_kmeans(rows, key, list(range(low, top + 1)), seed)
    search, best = [], None
    sums = _sums(rows, centres) if centres else {}
    for k in sorted(centres):
        names = merge_small(*sums[k], least)
        labelled = assigned(rows, centres[k], names)
        sizes = {int(c): int(sums[k][0][names == c].sum()) for c in np.unique(names[names > 0])}
        score = silhouette(labelled)
        search.append({"k": k, "n_clusters": len(sizes), "sizes": list(sizes.values()), "silhouette": score})
        if score is not None and (best is None or score > best[0]):
            best = (score, labelled)
        elif best is None and k == max(centres):
            best = (None, labelled)
    return (best[1] if best else rows.withColumn("cluster", F.lit(None).cast("long"))), search


def average_linkage(x: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, distance) of average linkage by cosine over weighted unit vectors; b joins a.

    The mean distance of two clusters follows from the sums of their members.
    """
    s, n = x * weight[:, None], weight.astype(float).copy()
    dist = 1 - np.clip(x @ x.T, -1, 1)
    np.fill_diagonal(dist, np.inf)
    alive, out = np.ones(len(x), bool), []
    for _ in range(len(x) - 1):
        a, b = divmod(int(dist.argmin()), len(x))
        a, b = min(a, b), max(a, b)
        out.append((a, b, float(max(dist[a, b], 0.0))))
        s[a] += s[b]
        n[a] += n[b]
        alive[b] = False
        dist[b], dist[:, b] = np.inf, np.inf
        near = np.where(alive, np.maximum(1 - (s @ s[a]) / (n * n[a]), 0.0), np.inf)
        near[a] = np.inf
        dist[a], dist[:, a] = near, near
    return out


def choose_linkage(rows: DataFrame, key: str, low: int = 5, high: int = 12) -> tuple[DataFrame, list[dict]]:
    """(rows with cluster from 1, the search): average linkage cut at the number with the best silhouette.

    Equal vectors are one with a weight. More than LINKAGE_MOST distinct vectors raise ValueError, as
    all their distances are held at once; k-means takes any number.
    """
    rows = cut(rows, "vectors")
    t = rows.groupBy("e").agg(F.count("*").alias("n")).limit(LINKAGE_MOST + 1).toArrow()
    if len(t) > LINKAGE_MOST:
        raise ValueError(f"more than {LINKAGE_MOST} distinct vectors")
    order = sorted(zip(t["e"].to_pylist(), t["n"].to_pylist()))
    x, w = np.array([o[0] for o in order], float), np.array([o[1] for o in order])
    merges, search, best = average_linkage(x, w), [], None
    for k in range(low, max(low, min(high, len(x) - 1)) + 1):
        to = np.arange(len(x))
        for a, b, _ in merges[: max(0, len(x) - k)]:
            to[to == b] = a
        names = np.searchsorted(np.unique(to), to) + 1
        labelled = assigned(rows, x, names)
        score = silhouette(labelled)
        search.append({"k": k, "n_clusters": len(np.unique(names)), "silhouette": score})
        if best is None or (score is not None and (best[0] is None or score > best[0])):
            best = (score, labelled)
    return (best[1] if best else rows.withColumn("cluster", F.lit(None).cast("long"))), search


def topics(titles: DataFrame, method: str = "kmeans", low: int = 5, high: int = 12, least: int = 15) -> tuple[DataFrame, list[dict]]:
    """(thread_id, cluster_id; the search). titles: thread_id (unique), title, e (unit vectors).

    Titles that say nothing are ``unusable``. Fewer than three titles, or only equal ones, are one topic.
    """
    good = titles.filter(~unusable(F.col("title")))
    kept = good.select(F.col("thread_id"), "e")
    n, kinds, vectors = good.agg(F.count("*"), F.approx_count_distinct("title"), F.approx_count_distinct("e")).first()
    if n < 3 or kinds == 1 or vectors == 1:
        found, search = kept.withColumn("cluster", F.lit(1).cast("long")), []
    elif method == "kmeans":
        top = min(high, n - 1)
        found, search = choose_spherical(kept, "thread_id", min(low, top), top, least)
    elif method == "average_linkage":
        top = min(high, n - 1)
        found, search = choose_linkage(kept, "thread_id", min(low, top), top)
    else:
        raise ValueError(f"unknown method {method}")
    rest = titles.filter(unusable(F.col("title"))).select("thread_id", F.lit("unusable").alias("cluster_id"))
    return found.select("thread_id", F.col("cluster").cast("string").alias("cluster_id")).unionByName(rest), search


def keywords(rows: DataFrame, group: str, key: str = "thread_id", n: int = 8, most: int = 4000, stop: list[str] = STOP_WORDS) -> DataFrame:
    """group, term, lead, rank: one- and two-word terms by how far their TF-IDF in a group is above that of all.

    rows: key (unique), title, group. Words are of two letters, digits or underscores at least, without
    stop words; only the ``most`` frequent terms count; weights are tf * (ln((1 + N) / (1 + df)) + 1),
    scaled to length 1 a title. Terms of digits alone are left out; ties by term.
    """
    words = F.filter(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*stop))
    t = rows.filter(F.col("title").isNotNull()).select(F.col(key).alias("__k"), F.col(group).alias("__g"), words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1)))
    terms = F.concat("w", F.when(F.size("w") >= 2, pairs).otherwise(F.array().cast("array<string>")))
    tf = cut(t.select("__k", "__g", F.explode(terms).alias("term")).groupBy("__k", "__g", "term").agg(F.count("*").alias("tf")), "terms")
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    df = df.orderBy(F.desc("cf"), "term").limit(most).select("term", "df")
    total = t.agg(F.count("*").alias("N"))
    x = tf.join(F.broadcast(df), "term").join(F.broadcast(total))  # ``most`` terms; one row
    x = x.withColumn("v", F.col("tf") * (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1))
    length = x.groupBy("__k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l"))
    by = x.join(length, "__k").groupBy("__g", "term").agg(F.sum(F.col("v") / F.col("l")).alias("v"))
    sizes = t.groupBy("__g").agg(F.count("*").alias("c"))
    every = by.groupBy("term").agg(F.sum("v").alias("a"))
    lead = F.col("v") / F.col("c") - F.col("a") / F.col("N")
    scored = by.join(F.broadcast(every), "term").join(sizes, "__g").join(F.broadcast(total)).select(F.col("__g").alias(group), "term", lead.alias("lead"))
    w = Window.partitionBy(group).orderBy(F.desc(F.round("lead", 9)), F.col("term"))
    return scored.filter(~F.col("term").rlike("^[0-9]+$")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def weight_summary(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, motion, n_human, n_sim, their mean weights and masses, and over complete pairs: n_pairs, delta_pp, n_positive.

    rows: thread_id, side, w_<motion> and the columns ``by``, equal on both sides of a thread.
    """
    by = list(by)
    long = rows.select(*by, "thread_id", "side", F.posexplode(F.array(*[F.col(f"w_{m}") for m in MOTIONS])).alias("k", "w"))
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("w")))
    pair = long.groupBy(*by, "thread_id", "k").agg(of("human").alias("h"), of("sim").alias("s"))
    names = F.array(*[F.lit(m) for m in MOTIONS])
    both = F.col("h").isNotNull() & F.col("s").isNotNull()
    d = F.when(both, F.col("s") - F.col("h"))
    return pair.groupBy(*by, F.get(names, F.col("k")).alias("motion")).agg(
        F.count("h").alias("n_human"), F.count("s").alias("n_sim"), F.avg("h").alias("mean_human"), F.avg("s").alias("mean_sim"),
        F.coalesce(F.sum("h"), F.lit(0.0)).alias("mass_human"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("mass_sim"),
        F.count(d).alias("n_pairs"), (100 * F.avg(d)).alias("delta_pp"), F.count_if(d > 0).alias("n_positive"),
    )


def total_variation(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, n, mean_total_variation: half the sum of absolute differences of weights, over complete pairs."""
    by = list(by)
    long = rows.select(*by, "thread_id", "side", F.array(*[F.col(f"w_{m}") for m in MOTIONS]).alias("w"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("w")))
    pair = long.groupBy(*by, "thread_id").agg(side("human").alias("h"), side("sim").alias("s")).filter("h is not null and s is not null")
    tv = F.aggregate(F.zip_with("h", "s", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / 2
    return pair.groupBy(*by).agg(F.count("*").alias("n"), F.avg(tv).alias("mean_total_variation"))


def topic_weights(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """The weight summary of each topic; both sides of a thread share its topic (thread_id, cluster_id)."""
    return weight_summary(rows.join(assignment, "thread_id"), ["cluster_id"])
