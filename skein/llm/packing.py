"""Items of varying length into containers of several permitted capacities.

Best-fit decreasing over the histogram of sizes: equal items and bins of equal free space are
handled together, so the plan depends on the number of distinct sizes (at most the largest
capacity), not on the number of items, and equals the plan made item by item. The capacities are
optimised jointly: where an item needs a new bin, the size opened is the one of least cost per
token, counting the waste that bins of a size end with, and plans that give up each size in turn
are made as well; of all plans the cheapest is taken. At the end each bin is downsized to its
contents. Items are matched to the plan by their rank among the items of equal size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.ranks import rank_within
from skein.session import cut


#: Cost of a container beside its tokens, as a share of the least capacity: full sequences of
#: unlike lengths cost about the same per token, and each one a little by itself.
BIN_COST = 0.001


def plan(histogram: dict[int, int], capacities: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Slots (size, first rank, end rank, items per bin, first bin) of the cheapest plan found.

    Plans differ in which capacities they may open bins of; every size larger than the others
    of a plan may always open the least capacity that holds it.
    """
    capacities = sorted(set(capacities))
    ways = [capacities] + [[c for c in capacities if c != left] for left in capacities[:-1]] + [[c] for c in capacities]
    best = None
    for way in ways:
        if way and max(way) >= max(histogram, default=0):
            for costly in (False, True) if len(way) > 1 else (False,):
                slots = _best_fit(histogram, way, costly)
                price = cost(slots, capacities)
                if best is None or price < best[0] - 1e-9:
                    best = (price, slots)
    return best[1] if best else []


def cost(slots: list[tuple[int, int, int, int, int]], capacities: list[int]) -> float:
    """Tokens of all bins after downsizing, and BIN_COST of the least capacity for each bin."""
    used: dict[int, int] = {}
    runs: list[tuple[int, int, int]] = []  # first bin, end bin, tokens in each
    for size, a, b, per, first in slots:
        runs.append((first, first + (b - a) // per, size * per))
    edges = sorted({x for a, b, _ in runs for x in (a, b)})
    place = {x: k for k, x in enumerate(edges)}
    step = [0] * (len(edges) + 1)
    for a, b, n in runs:
        step[place[a]] += n
        step[place[b]] -= n
    total, now = 0.0, 0
    for k, x in enumerate(edges[:-1]):
        now += step[k]
        used[now] = used.get(now, 0) + edges[k + 1] - x
    for n, bins in used.items():
        if n:
            total += bins * (next(c for c in capacities if c >= n) + BIN_COST * capacities[0])
    return total


def _best_fit(histogram: dict[int, int], capacities: list[int], costly: bool) -> list[tuple[int, int, int, int, int]]:
    """Slots of a best-fit packing into bins of these capacities.

    With ``costly`` a new bin is of the size that leaves the least share unused when it is filled
    with items like the first; else of the least size that holds the item.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> runs (first bin, bins)
    spaces: list[int] = []
    slots, bins = [], 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            at = bisect_left(spaces, size)
            if at < len(spaces):
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space], spaces[at]
            else:
                fits = [c for c in capacities if c >= size]
                space = min(fits, key=lambda c: ((c % size) / c, c)) if costly else fits[0]
                per = space // size
                first, n = bins, -(-left // per)
                bins += n
            per = space // size
            full = min(n, left // per)
            if full:
                slots.append((size, rank, rank + full * per, per, first))
                put(space - per * size, first, full)
                rank, left = rank + full * per, left - full * per
            rest = n - full
            if rest and left and left < per:
                slots.append((size, rank, rank + left, left, first + full))
                put(space - left * size, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
                rest -= 1
            put(space, first + full, rest)
    return slots


def pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, n_pieces, n): items above the capacity in full pieces and a rest, others whole."""
    n = F.col(size)
    count = F.ceil(n / F.lit(capacity)).cast("int")
    out = sizes.filter(n > 0).select(key, n.alias("__n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"), count.alias("n_pieces"))
    rest = F.col("__n") - F.col("piece").cast("long") * capacity
    return out.select(key, "piece", "n_pieces", F.least(F.lit(capacity).cast("long"), rest).alias("n"))


def pack(sizes: DataFrame, key: str, size: str, capacities: list[int]) -> DataFrame:
    """(key, piece, n_pieces, n, container_id): every item or piece in exactly one container.

    Only items larger than the largest capacity are split. Items of null or no size need no
    container and are left out; an empty table gives an empty result. Equal sizes and repeated
    keys are fine: each row is an item. Extra columns are dropped, whatever their names.
    """
    if not capacities:
        raise ValueError("no capacity is permitted")
    items = cut(pieces(sizes, key, size, max(capacities)), "items")
    histogram = {r["n"]: r["count"] for r in items.groupBy("n").count().collect()}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    for size, a, _, per, first in sorted(plan(histogram, capacities)):
        slots.setdefault(size, []).append((a, per, first))
    # at most a few slots per distinct size, so the plan is bounded by the largest capacity
    table = {n: tuple(np.array(c, np.int64) for c in zip(*s)) for n, s in slots.items()}
    shared = items.sparkSession.sparkContext.broadcast(table)
    ranked = rank_within(items, "n", [key, "piece"]).select(key, "piece", "n_pieces", "n", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            out = np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            ends = np.flatnonzero(np.diff(n[order], append=-1)) + 1
            start = 0
            for end in ends.tolist():
                at = order[start:end]
                a, per, first = shared.value[int(n[at[0]])]
                k = np.searchsorted(a, rank[at], "right") - 1  # the one slot of a rank
                out[at] = first[k] + (rank[at] - a[k]) // per[k]
                start = end
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], [*batch.schema.names[:4], "container_id"])

    schema = T.StructType([*ranked.schema.fields[:4], T.StructField("container_id", T.LongType())])
    return ranked.mapInArrow(place, schema)


def containers(packed: DataFrame, capacities: list[int]) -> DataFrame:
    """(container_id, used, n_items, capacity, unused): each container downsized to its contents."""
    used = packed.groupBy("container_id").agg(F.sum("n").alias("used"), F.count("*").alias("n_items"))
    fit = None
    for c in sorted(capacities, reverse=True):
        fit = F.lit(c) if fit is None else F.when(F.col("used") <= c, F.lit(c)).otherwise(fit)
    return used.withColumn("capacity", fit.cast("long")).withColumn("unused", F.col("capacity") - F.col("used"))
