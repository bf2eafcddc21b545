"""Checks that rows keep their contract; each returns the rows that do not, with the reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.vectors import finite
from skein.operators.motion import METHOD, MOTIONS

SERIES = ("sims", "sigma", "eff_dim", "k_modes", "chi", "chi_step")
#: What trajectories must share to be scored together; a missing one equals another missing one.
SETTINGS = ("embedder", "center_mean", "window_size", "support_size", "k_cluster_distance")
#: What weights must share to be compared.
PROTOCOL = ("method", "temperature", "scales")


def demand(violations: DataFrame, what: str) -> None:
    """Raise ValueError with the first reasons if there are violations."""
    first = violations.limit(3).collect()
    if first:
        raise ValueError(f"{what}: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in first))


def _same(rows: DataFrame, columns: tuple[str, ...], reason: str) -> DataFrame:
    """One row if the columns that are there take more than one combination of values."""
    there = [c for c in columns if c in rows.columns]
    none = F.lit(None).cast("string")
    kinds = rows.select(*[F.col(c).cast("string") for c in there]).distinct().agg(F.count("*").alias("__n")).filter("__n > 1")
    return kinds.select(none.alias("thread_id"), none.alias("side"), F.lit(reason).alias("reason"))


def _empty(rows: DataFrame, reason: str) -> DataFrame:
    none = F.lit(None).cast("string")
    n = rows.agg(F.count("*").alias("__n")).filter("__n = 0")
    return n.select(none.alias("thread_id"), none.alias("side"), F.lit(reason).alias("reason"))


def _sides(rows: DataFrame, paired: tuple[str, ...]) -> DataFrame:
    """Threads without both sides, or with sides that differ; only asked for if any side is simulated."""
    per = [x for c in paired for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))]
    sides = rows.groupBy("thread_id").agg(F.collect_set("side").alias("__s"), *per)
    any_sim = rows.filter("side = 'sim'").limit(1).select(F.lit(1).alias("__sim"))  # one row at most
    sides = sides.join(F.broadcast(any_sim))
    reason = F.when(F.size("__s") < 2, F.lit("incomplete pair"))
    for c in paired:
        reason = reason.when(~F.col(f"__lo_{c}").eqNullSafe(F.col(f"__hi_{c}")), F.lit(f"paired {c} differ"))
    return sides.select(F.col("thread_id").cast("string").alias("thread_id"), F.lit(None).cast("string").alias("side"), reason.alias("reason")).filter("reason is not null")


def _single(rows: DataFrame, reason) -> DataFrame:
    return rows.select(F.col("thread_id").cast("string").alias("thread_id"), "side", reason.alias("reason")).filter("reason is not null")


def _repeats(rows: DataFrame) -> DataFrame:
    n = rows.groupBy("thread_id", "side").agg(F.count("*").alias("__n")).filter("__n > 1")
    return n.select(F.col("thread_id").cast("string").alias("thread_id"), "side", F.lit("repeated").alias("reason"))


def trajectory_violations(rows: DataFrame) -> DataFrame:
    """thread_id, side, reason: what keeps trajectories from being scored together.

    Missing keys, unknown sides, repeats, fewer than two windows or fewer comments than windows,
    an end that is not finite, series of another length than n_windows or not finite, more than
    one setting of SETTINGS, and, if any side is simulated, threads without both sides or with
    sides of different counts. An empty table is a violation too.
    """
    bad = [F.coalesce(F.size(s), F.lit(-1)) != F.col("n_windows") for s in SERIES]
    bad += [F.exists(F.coalesce(s, F.array()), lambda x: ~finite(x)) for s in SERIES]
    bad_series = reduce(lambda a, b: a | b, bad)
    bad_end = F.col("s_end").isNotNull() & ~finite(F.col("s_end")) if "s_end" in rows.columns else F.lit(False)
    reason = (
        F.when(F.coalesce(F.col("thread_id").cast("string"), F.lit("")) == "", "no thread").when(~F.coalesce("side", F.lit("")).isin("human", "sim"), "unknown side")
        .when(F.coalesce("n_windows", F.lit(0)) < 2, "fewer than two windows")
        .when(F.coalesce("n_comments", F.lit(-1)) < F.col("n_windows"), "fewer comments than windows")
        .when(bad_end, "end not finite").when(bad_series, "series of wrong length or not finite")
    )
    out = _single(rows, reason).unionByName(_repeats(rows)).unionByName(_sides(rows, ("n_windows", "n_comments"))).unionByName(_empty(rows, "no trajectories"))
    return out.unionByName(_same(rows, SETTINGS, "mixed settings")) if set(SETTINGS) & set(rows.columns) else out


def weight_violations(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """thread_id, side, reason: weights that are no distribution, repeats, mixed protocols, unlike or lone sides.

    rows: thread_id, side, w_<motion> and, where kept, title and the columns of PROTOCOL.
    """
    w = [F.col(f"w_{m}") for m in MOTIONS]
    fine = F.abs(sum(w[1:], w[0]) - 1) <= tolerance
    for x in w:
        fine = fine & finite(x) & (x >= 0)
    reason = F.when(~F.coalesce("side", F.lit("")).isin("human", "sim"), "unknown side").when(~F.coalesce(fine, F.lit(False)), "no distribution")
    if "method" in rows.columns:
        reason = reason.when(F.coalesce("method", F.lit("")) != METHOD, "unknown method")
    titled = rows.withColumn("title", F.coalesce("title", F.lit(""))) if "title" in rows.columns else rows
    paired = ("title",) if "title" in rows.columns else ()
    out = _single(rows, reason).unionByName(_repeats(rows)).unionByName(_sides(titled, paired)).unionByName(_empty(rows, "no weights"))
    return out.unionByName(_same(rows, PROTOCOL, "mixed protocols")) if set(PROTOCOL) & set(rows.columns) else out


def same_protocol(frozen: dict[str, object], rows: DataFrame) -> None:
    """Raise ValueError unless the settings that kept scales were fitted under are those of ``rows``."""
    there = [c for c in SETTINGS if c in rows.columns]
    for r in rows.select(*there).distinct().limit(2).collect() if there else []:
        wrong = [c for c in there if r[c] != frozen.get(c)]
        if wrong:
            raise ValueError(f"scales were fitted with other settings: {', '.join(wrong)}")


def shared_titles(rows: DataFrame) -> DataFrame:
    """thread_id, title: each thread once, whichever sides it has; raises ValueError on a broken contract."""
    demand(weight_violations(rows), "weights")
    return rows.groupBy("thread_id").agg(F.max(F.coalesce("title", F.lit(""))).alias("title"))


def replay_violations(human: DataFrame, headers: DataFrame, sim: DataFrame) -> DataFrame:
    """post_id, position, reason: what keeps a simulated thread from being read against its original.

    human: post_id, position, author, alias, comment_id, body. headers: post_id, file_id, n_turns
    (one a simulated file; file_id is the name the file has). sim: file_id, the columns of human but
    post_id, and error, shown_indices. Reasons without a position concern the whole thread. Each
    turn must name the same position, author, comment and alias, be counted from 0 without gaps,
    have text on both sides, no error, and may have seen each earlier turn once at most.
    """
    no_turn = F.lit(None).cast("long").alias("position")
    sizes = human.groupBy("post_id").agg(F.count("*").alias("n"))
    sims = sim.groupBy(F.col("file_id").alias("post_id")).agg(F.count("*").alias("m"))
    heads = headers.groupBy(F.col("file_id").alias("post_id")).agg(F.count("*").alias("h"), F.max("n_turns").alias("told"), F.max("post_id").alias("named"))
    whole = sizes.join(heads, "post_id", "left").join(sims, "post_id", "left")
    reason = (
        F.when(~F.col("post_id").rlike("^[A-Za-z0-9_-]+$"), "invalid thread id").when(F.col("h").isNull(), "missing header")
        .when(F.col("h") > 1, "repeated header").when(~F.col("named").eqNullSafe(F.col("post_id")), "thread id differs")
        .when((F.coalesce("told", F.lit(-1)) != F.col("n")) | (F.coalesce("m", F.lit(0)) != F.col("n")), "turn counts differ")
    )
    out = whole.select("post_id", no_turn, reason.alias("reason")).filter("reason is not null")
    repeated = human.groupBy("post_id", "position").agg(F.count("*").alias("k")).filter("k > 1").select("post_id", "position", F.lit("repeated thread").alias("reason"))
    keys = ("author", "comment_id", "alias")
    h = human.select("post_id", "position", F.lit(True).alias("__h"), *[F.col(c).alias(f"h_{c}") for c in keys], F.col("body").alias("h_body"))
    s = sim.select(F.col("file_id").alias("post_id"), "position", F.lit(True).alias("__s"), *[F.col(c).alias(f"s_{c}") for c in keys], F.col("body").alias("s_body"), "error", "shown_indices")
    pair = h.join(sizes, "post_id").join(s, ["post_id", "position"], "full")
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit("")) == ""
    shown = F.col("shown_indices")
    seen_wrong = shown.isNull() | (F.size(F.array_distinct(shown)) != F.size(shown)) | F.exists(shown, lambda x: x.isNull() | (x < 0) | (x >= F.col("position")))
    reason = F.when(F.col("__h").isNull() | F.col("__s").isNull(), "position differs")
    for c in keys:
        reason = reason.when(F.col(f"h_{c}").isNull() | ~F.col(f"h_{c}").eqNullSafe(F.col(f"s_{c}")), f"{c} differs")
    reason = (
        reason.when((F.col("position") < 0) | (F.col("position") >= F.col("n")), "gap in positions")
        .when((F.coalesce("error", F.lit("")) != "") | blank("s_body"), "failed or empty simulation").when(blank("h_body"), "empty human comment")
        .when(seen_wrong, "invalid visible history")
    )
    turns = pair.join(sizes.select("post_id"), "post_id", "left_semi").select("post_id", "position", reason.alias("reason")).filter("reason is not null")
    return out.unionByName(repeated).unionByName(turns)


def replay_audit(human: DataFrame, headers: DataFrame, sim: DataFrame, size: int = 10, limit: int = 0) -> DataFrame:
    """post_id, n_turns, n_truncated, valid, reason: the pairs to be read, the others with their first reason.

    A valid pair has more than ``size`` turns, so that there are two windows. limit: threads in
    order of their id, 0 for all. sim has a column truncated.
    """
    if limit:
        human = human.join(human.select("post_id").distinct().orderBy("post_id").limit(limit), "post_id", "left_semi")
    bad = replay_violations(human, headers, sim)
    first = bad.groupBy("post_id").agg(F.min_by("reason", F.struct(F.coalesce("position", F.lit(-1)), "reason")).alias("why"))
    n = human.groupBy("post_id").agg(F.count("*").alias("n_turns"))
    cuts = sim.groupBy(F.col("file_id").alias("post_id")).agg(F.count_if(F.coalesce("truncated", F.lit(False))).alias("n_truncated"))
    out = n.join(first, "post_id", "left").join(cuts, "post_id", "left")
    reason = F.coalesce("why", F.when(F.col("n_turns") <= size, "fewer than two windows"))
    return out.select("post_id", "n_turns", F.coalesce("n_truncated", F.lit(0)).alias("n_truncated"), reason.isNull().alias("valid"), reason.alias("reason"))
