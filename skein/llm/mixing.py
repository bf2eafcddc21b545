"""Sources mixed to target shares by Poisson replication.

Each document draws how often it is used from a Poisson distribution whose mean is the rate its
source needs, by inverting the distribution at a hash of its id; draws stop at the source's cap,
and the mean is raised so that the capped draws still have the rate. Of a fixed set of rotations
of the hashes each source takes the one whose draws come closest to its target, so that sources
of few documents reach their shares as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of what a source could give at most (every document at its cap) that is asked of it.
STRETCH = 0.8
ROTATIONS = 64


def capped_mean(lam: float, cap: int) -> float:
    """Mean of min(Poisson(lam), cap)."""
    p, total, tail = math.exp(-lam), 0.0, 1.0
    for k in range(cap):
        total += k * p
        tail -= p
        p *= lam / (k + 1)
    return total + cap * max(0.0, tail)


def thresholds(rate: float, cap: int) -> list[float]:
    """P(draw <= k) for k < cap, of the capped Poisson distribution with mean ``rate``."""
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < rate and high < 700:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < rate else (low, mid)
    p, out, total = math.exp(-high), [], 0.0
    for k in range(cap):
        total += p
        out.append(min(1.0, total))
        p *= high / (k + 1)
    return out


def _draw(u: Column, steps: Column) -> Column:
    return F.size(F.filter(steps, lambda t: t <= u))


def rates(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> tuple[float, dict[str, float]]:
    """(tokens of the mixture, mean uses per source).

    The mixture is as large as the caps allow: no source is asked for more than STRETCH of its
    documents at their cap. Sources without tokens or with a share or cap of 0 give nothing.
    """
    live = {s: (w, c) for s, (w, c) in targets.items() if totals.get(s) and w > 0 and c > 0}
    if not live:
        return 0.0, {}
    weight = sum(w for w, _ in live.values())
    size = min(STRETCH * c * totals[s] * weight / w for s, (w, c) in live.items())
    return size, {s: w / weight * size / totals[s] for s, (w, _) in live.items()}


def mix(docs: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, copy, order_key): the mixture, in a global pseudo-random order.

    docs: doc_id (unique), source, n_tokens; targets: source, target_share, max_repeats. Documents
    of sources that are null or not listed are left out, as are those of no tokens. Rows come
    range-partitioned and sorted by ``order_key``. Empty tables give an empty mixture.
    """
    spark = docs.sparkSession
    want = {r["source"]: (r["target_share"] or 0.0, int(r["max_repeats"] or 0)) for r in targets.distinct().collect()}
    rows = docs.select("doc_id", "source", "n_tokens").filter(F.col("source").isin(list(want)) & (F.col("n_tokens") > 0))
    totals = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    size, rate = rates(totals, want)
    steps = {s: thresholds(r, want[s][1]) for s, r in rate.items()}
    table = spark.createDataFrame(
        [(s, x, float(rate[s] * totals[s])) for s, x in steps.items()], "source string, steps array<double>, goal double"
    )
    # one row per source of the mixture; its size is that of the table of targets
    rows = rows.join(F.broadcast(table), "source")
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) / float(1 << 52)
    rows = rows.withColumn("u", u)
    turned = lambda k: (F.col("u") + k / ROTATIONS) - F.floor(F.col("u") + k / ROTATIONS)
    sums = [F.sum(F.col("n_tokens") * _draw(turned(k), F.col("steps"))).alias(f"r{k}") for k in range(ROTATIONS)]
    best = []
    for r in rows.groupBy("source", "goal").agg(*sums).collect():
        k = min(range(ROTATIONS), key=lambda k: (abs(r[f"r{k}"] - r["goal"]), k))
        best.append((r["source"], k / ROTATIONS))
    turn = spark.createDataFrame(best, "source string, turn double")
    rows = rows.join(F.broadcast(turn), "source")
    v = F.col("u") + F.col("turn")
    rows = rows.withColumn("uses", _draw(v - F.floor(v), F.col("steps"))).filter("uses > 0")
    copies = rows.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("copy"))
    copies = copies.withColumn("order_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy"))
    return copies.repartitionByRange("order_key").sortWithinPartitions("order_key")


def report(docs: DataFrame, mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: share wanted and reached, tokens, documents, most uses of one, cap."""
    uses = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("tokens"))
    got = uses.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses")
    )
    total = got.agg(F.sum("tokens").alias("total"))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    out = targets.distinct().join(got, "source", "left").join(have, "source", "left").join(F.broadcast(total), how="left")
    zero = F.lit(0).cast("long")
    return out.select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", zero).alias("tokens"), F.coalesce("source_tokens", zero).alias("source_tokens"),
        F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("most_uses", zero).alias("most_uses"), "max_repeats",
    )
