"""Choices of rows: the first of a group, samples, aliases, merges of deliveries, look-ups.

Ranks within groups keep few rows per group only, which Spark decides on each task before the
shuffle, so that a group of any size sends little; where ranks over whole groups are needed, rows
are numbered by :func:`skein.operators.ordering.positions`, which splits groups over tasks.
Equal candidates are told apart by the order of first appearance where rows have one, and by id.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.ordering import positions


def top(rows: DataFrame, group: Sequence[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in a total order, with their rank from 1."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def eligible_slice(rows: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` in a total order over the whole table (limit 0: all after)."""
    numbered = positions(rows.withColumn("__all", F.lit(0)), "__all", order, "__n").drop("__all")
    kept = numbered.filter(F.col("__n") >= skip)
    return (kept.filter(F.col("__n") < skip + limit) if limit else kept).drop("__n")


def cast_of(comments: DataFrame, size: int, least: int, elsewhere: DataFrame | None = None, least_elsewhere: int = 0) -> DataFrame:
    """post_id, author, n, r, alias: the most frequent authors of each thread.

    comments: post_id, author, pos. Authors need ``least`` comments in the thread and
    ``least_elsewhere`` threads in ``elsewhere`` (author, n_threads; 0 if absent). Of equals the one
    seen first comes first. Threads with fewer than ``size`` such authors are left out.
    """
    per = comments.groupBy("post_id", "author").agg(F.count("*").alias("n"), F.min("pos").alias("__first")).filter(F.col("n") >= least)
    if elsewhere is not None:
        per = per.join(elsewhere.select("author", "n_threads"), "author", "left").filter(F.coalesce("n_threads", F.lit(0)) >= least_elsewhere).drop("n_threads")
    best = top(per, ["post_id"], [F.desc("n"), F.col("__first")], size, "r")
    full = best.groupBy("post_id").agg(F.count("*").alias("__k")).filter(F.col("__k") >= size)
    return best.join(full, "post_id", "left_semi").select("post_id", "author", "n", "r", F.concat(F.lit("Agent-"), F.col("r")).alias("alias"))


def aliases(comments: DataFrame) -> DataFrame:
    """post_id, author, k, alias: authors of each thread by first appearance, Agent-1 first."""
    seen = comments.groupBy("post_id", "author").agg(F.min("pos").alias("__first"))
    numbered = positions(seen, "post_id", [F.col("__first")], "k").drop("__first")
    k = F.col("k") + 1
    return numbered.select("post_id", "author", k.alias("k"), F.concat(F.lit("Agent-"), k.cast("string")).alias("alias"))


def author_samples(comments: DataFrame, n: int = 6) -> DataFrame:
    """author, post_id, id, rank: up to ``n`` comments of each author, the first one of a thread each.

    Threads come in the order of their time of creation and id (comments: post_id, author, id, pos,
    thread_created).
    """
    first = comments.groupBy("author", "post_id").agg(F.min_by(F.struct("id", "thread_created"), "pos").alias("c"))
    rows = first.select("author", "post_id", "c.id", "c.thread_created")
    return top(rows, ["author"], [F.col("thread_created"), F.col("post_id")], n).drop("thread_created")


def spread_by_length(rows: DataFrame, group: str, n: int = 5) -> DataFrame:
    """Rows evenly spaced by the length of ``body`` (id breaks ties): both ends and what lies between.

    Groups of at most ``n`` rows are kept whole. Places are rounded half to even.
    """
    numbered = positions(rows.withColumn("__len", F.length("body")), group, [F.col("__len"), F.col("id")], "__i").drop("__len")
    sizes = rows.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    wanted = F.when(F.col("__n") <= n, F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).otherwise(
        F.array(*[F.bround(F.lit(i) * (F.col("__n") - 1) / F.lit(max(n - 1, 1))).cast("long") for i in range(n)])
    )
    places = sizes.select("__g", F.explode(F.array_distinct(wanted)).alias("__at"))
    out = numbered.join(places, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__i") == F.col("__at")))
    return out.drop("__g", "__at").withColumnRenamed("__i", "place")


def verbatim(rows: DataFrame, group: str, n: int = 5, most: int = 400) -> DataFrame:
    """group, id, rank, sample: the bodies closest in length to the median of their group, cut to ``most``.

    The median is truncated to a whole number; of equals the one first in order of ``id`` comes first.
    """
    lengths = rows.groupBy(F.col(group).alias("__g"), F.length("body").alias("__x")).agg(F.count("*").alias("__n"))
    median = lengths.groupBy("__g").agg(F.percentile("__x", F.lit(0.5), F.col("__n")).cast("int").alias("__m"))
    near = rows.join(median, F.col(group).eqNullSafe(F.col("__g"))).withColumn("__d", F.abs(F.length("body") - F.col("__m")))
    best = top(near, [group], [F.col("__d"), F.col("id")], n)
    return best.select(group, "id", "rank", F.substring("body", 1, most).alias("sample"))


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, median: the value at place n // 2 of the sorted values, not interpolated."""
    v = rows.filter(F.col(value).isNotNull())
    numbered = positions(v, group, [F.col(value)], "__i")
    sizes = v.groupBy(F.col(group).alias("__g")).agg(F.floor(F.count("*") / 2).alias("__at"))
    hit = numbered.join(sizes, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__i") == F.col("__at")))
    return hit.select(group, F.col(value).alias("median"))


def nearest(rows: DataFrame, group: str, distance: Column, then: list[Column]) -> DataFrame:
    """One row of each group: the least distance, ties by ``then`` (which must be total)."""
    return top(rows.withColumn("__d", distance), [group], [F.col("__d"), *then], 1).drop("__d", "rank")


def typical(rows: DataFrame, group: str, value: str, other: str, size: str, at: int, key: str) -> DataFrame:
    """The row of each group closest to its means of ``value`` and (half as heavy) ``other``, then to ``at`` in ``size``."""
    fine = F.when(~F.isnan(other), F.col(other))
    means = rows.groupBy(F.col(group).alias("__g")).agg(F.avg(value).alias("__v"), F.avg(fine).alias("__o"))
    near = rows.join(means, F.col(group).eqNullSafe(F.col("__g")))
    d = F.abs(F.col(value) - F.col("__v")) + 0.5 * F.abs(F.coalesce(fine, F.lit(0.0)) - F.coalesce("__o", F.lit(0.0)))
    return nearest(near, group, d, [F.abs(F.col(size) - at), F.col(key)]).drop("__g", "__v", "__o")


def winners(rows: DataFrame, classes: Sequence[str], per_class: int = 2) -> DataFrame:
    """Audit examples: the clearest rows of each class; for a class without any the nearest miss.

    rows: post_id, motion, margin and a score r_<class> for each class. Adds class, pick, rank.
    """
    score = F.coalesce(*[F.when(F.col("motion") == c, F.col(f"r_{c}")) for c in classes])
    won = top(rows.withColumn("__s", score), ["motion"], [F.desc("margin"), F.desc("__s"), F.col("post_id")], per_class).drop("__s")
    won = won.withColumn("class", F.col("motion")).withColumn("pick", F.lit("winner"))
    here = rows.select(F.col("motion").alias("class")).distinct()  # at most as many rows as classes
    long = rows.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"r_{c}").alias("s")) for c in classes])).alias("__x"))
    missing = long.select(*rows.columns, "__x.class", F.col("__x.s").alias("__s")).join(F.broadcast(here), "class", "left_anti")
    near = top(missing, ["class"], [F.desc("__s"), F.col("post_id")], 1).drop("__s").withColumn("pick", F.lit("near_miss"))
    return won.unionByName(near)


def shuffled(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each group in an order fixed by the seed: a sample that any run repeats."""
    return top(rows, [group], [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], n)


def subsample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of the table in an order fixed by the seed; the whole table if it has no more."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)


def preferred_first(rows: DataFrame, key: str, preferred: DataFrame) -> DataFrame:
    """Add place: rows named in ``preferred`` (key) before the others, each part in order of the key."""
    marks = preferred.select(F.col(key).alias("__p")).distinct()
    marked = rows.join(marks, F.col(key) == F.col("__p"), "left").withColumn("__late", F.col("__p").isNull()).drop("__p")
    return positions(marked.withColumn("__all", F.lit(0)), "__all", [F.col("__late"), F.col(key)], "place").drop("__all", "__late")


def merged(rows: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """One row for each key, the first (or last) in ``order``, and seen: the first place of the key.

    Rows with a null or blank key are all kept when the first wins, as nothing tells them apart, and
    dropped when the last wins. ``order`` must be total.
    """
    blank = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    sort = F.struct(*order)
    others = [c for c in rows.columns if c != key]
    pick = F.max_by if last else F.min_by
    one = rows.filter(~blank).groupBy(key).agg(pick(F.struct(*others), sort).alias("__r"), F.min(sort).alias("seen"))
    out = one.select(key, *[F.col("__r")[c].alias(c) for c in others], "seen")
    return out if last else out.unionByName(rows.filter(blank).withColumn("seen", sort))


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, place: distinct keys in the order in which they first appear."""
    seen = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("__o"))
    return positions(seen.withColumn("__all", F.lit(0)), "__all", [F.col("__o")], "place").drop("__all", "__o")


def wanted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is asked for, asked-for keys that no row has)."""
    return rows.join(ids.select(key).distinct(), key, "left_semi"), ids.select(key).distinct().join(rows, key, "left_anti")


def not_blocked(history: DataFrame, blocked: DataFrame, keys: Sequence[str] = ("post_id",)) -> DataFrame:
    """History rows outside the blocked posts; rows without a post stay."""
    return history.join(blocked.select(*keys).distinct(), list(keys), "left_anti")


def all_in(sets: DataFrame, group: str, member: str, known: DataFrame) -> DataFrame:
    """group, n, n_missing, complete: whether every member of a group is in ``known`` (column member)."""
    k = known.select(F.col(member)).distinct().withColumn("__k", F.lit(True))
    g = sets.join(k, member, "left").groupBy(group).agg(F.countDistinct(member).alias("n"), F.countDistinct(F.when(F.col("__k").isNull(), F.col(member))).alias("n_missing"))
    return g.withColumn("complete", F.col("n_missing") == 0)


def labelled(rows: DataFrame, labels: DataFrame, key: str, label: str, default: str = "unmatched") -> DataFrame:
    """Rows with the label of their key, ``default`` where there is none."""
    one = labels.groupBy(F.col(key).alias("__k")).agg(F.min(label).alias("__l"))
    return rows.join(one, F.col(key) == F.col("__k"), "left").withColumn(label, F.coalesce("__l", F.lit(default))).drop("__k", "__l")


def annotated(rows: DataFrame, notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both sides with the notes (keys and more) that both share; rows without notes are left out."""
    return rows.join(notes, list(keys))


def preferred(wanted_keys: DataFrame, key: str, existing: DataFrame, reused: DataFrame, source: str) -> DataFrame:
    """key, origin, card: an existing valid card of the same source, else a reused valid one, else none (new).

    existing, reused: key, source, card, error. A card is valid if it has no error.
    """
    valid = (F.coalesce("error", F.lit("")) == "") & F.col("card").isNotNull()
    own = existing.filter(valid & (F.col("source") == source)).groupBy(key).agg(F.min("card").alias("__own"))
    other = reused.filter(valid).groupBy(key).agg(F.min("card").alias("__other"))
    out = wanted_keys.select(key).distinct().join(own, key, "left").join(other, key, "left")
    origin = F.when(F.col("__own").isNotNull(), "existing").when(F.col("__other").isNotNull(), "reused").otherwise("new")
    return out.select(key, origin.alias("origin"), F.coalesce("__own", "__other").alias("card"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def history_view(n_prev: pd.Series, recent: pd.Series, earlier: pd.Series, seed: pd.Series, post_id: pd.Series, step: pd.Series) -> pd.Series:
    """Places of earlier turns that a turn may see: the last ``recent`` and a seeded draw of ``earlier``.

    All of them if there are no more than that. The draw hangs on seed, post and step only.
    """
    return pd.Series([visible(*map(int, x[:4]), x[4], int(x[5])) for x in zip(n_prev, recent, earlier, seed, post_id, step)])


def visible(n_prev: int, recent: int, earlier: int, seed: int, post_id: str, step: int) -> list[int]:
    if n_prev <= recent + earlier:
        return list(range(max(0, n_prev)))
    old = n_prev - recent
    return sorted(random.Random(f"{seed}:{post_id}:{step}").sample(range(old), earlier)) + list(range(old, n_prev))
