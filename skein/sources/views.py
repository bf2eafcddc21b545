"""Views of the stored tables as the records the analyses work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.vectors import doubles
from skein.operators.discussion import NOBODY, STRIP, by_persons, linearise, renumbered
from skein.operators.hierarchy import fullname_id
from skein.sources.tables import table

#: Vectors per thread of the cloud view; a bound on every group of it.
CLOUD = 100


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """thread_id, pos, e: blocks of CLOUD consecutive vectors as threads."""
    v = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("thread_id").orderBy("vec_id")
    v = v.select("vec_id", F.floor(F.col("vec_id") / CLOUD).alias("thread_id"), doubles(F.col("embedding")).alias("e"))
    return v.select("thread_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), "e")


def paired_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """thread_id, side, pos, e: even vectors are the human side, odd ones the simulated side."""
    c = cloud(spark, sf_dir)
    side = F.when(F.col("pos") % 2 == 0, F.lit("human")).otherwise(F.lit("sim"))
    return c.select("thread_id", side.alias("side"), F.floor(F.col("pos") / 2).alias("pos"), "e")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comment once, cleaned: bodies stripped, empty and removed ones dropped."""
    c = table(spark, sf_dir, "comments")
    body = F.regexp_replace("body", STRIP, "")
    # of a comment delivered again all of these are the same
    c = c.select(
        "post_id", "id", fullname_id(F.col("parent_id")).alias("parent_id"),
        F.coalesce(F.nullif("author", F.lit("")), F.lit("[unknown]")).alias("author"), body.alias("body"),
        F.coalesce(F.col("created_utc").cast("double"), F.lit(0.0)).alias("created_utc"), F.coalesce(F.col("parent_id").startswith("t3_"), F.lit(False)).alias("to_post"),
    )
    return c.filter(~F.col("body").isin("", "[deleted]", "[removed]")).dropDuplicates(["post_id", "id"])


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each thread once, as last retrieved."""
    t = table(spark, sf_dir, "threads")
    others = [c for c in t.columns if c != "post_id"]
    last = t.groupBy("post_id").agg(F.max_by(F.struct(*others), "retrieved_at").alias("r"))
    return last.select("post_id", "r.*")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of persons in reading order: post_id, id, author, body and pos counted over them."""
    known = by_persons(linearise(comments(spark, sf_dir)), "author").filter(F.col("author") != "[unknown]")
    return renumbered(known).select("post_id", "id", "author", "body", "created_utc", "pos")


def series(spark: SparkSession, sf_dir: str, size: int = 10) -> DataFrame:
    """thread_id, win, y: the mean value of each block of ``size`` events of a user."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select(F.col("user_id").alias("thread_id"), F.floor((F.row_number().over(w) - 1) / size).alias("win"), "value")
    return e.groupBy("thread_id", "win").agg(F.avg("value").alias("y"))


def event_series(spark: SparkSession, sf_dir: str, size: int = 10) -> DataFrame:
    """Series read off the events of users, in the form of cloud series: thread_id, side, win, n and series.

    Users 2k and 2k + 1 are the human and the simulated side of thread k; a window is a block of
    ``size`` events. All values are rounded, so that any engine gets the same ones.
    """
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.select("user_id", F.floor((F.row_number().over(w) - 1) / size).alias("win"), "value", "event_type")
    g = e.groupBy("user_id", "win").agg(
        F.count("*").alias("n"), F.avg("value").alias("y"), F.stddev_pop("value").alias("sd"), F.countDistinct("event_type").alias("kinds"),
        F.countDistinct(F.floor(F.col("value") / 40)).alias("bands"), (F.count_if(F.col("event_type") == "click") / F.count("*")).alias("clicks"),
        (F.count_if(F.col("value") > 50) / F.count("*")).alias("high"),
    )
    by = Window.partitionBy("user_id").orderBy("win")
    r = lambda c: F.round(c, 9)
    sims = 1 / (1 + F.abs(F.col("y") - F.first("y").over(by)) / 50)
    return g.select(
        F.floor(F.col("user_id") / 2).alias("thread_id"), F.when(F.col("user_id") % 2 == 0, "human").otherwise("sim").alias("side"), "win", "n",
        r(sims).alias("sims"), r(F.col("sd") / 100).alias("sigma"), F.col("kinds").cast("double").alias("eff_dim"),
        F.least(F.col("bands"), F.lit(5)).cast("double").alias("k_modes"), r(F.abs(F.col("clicks") - F.first("clicks").over(by))).alias("chi"),
        r(F.coalesce(F.abs(F.col("clicks") - F.lag("clicks").over(by)), F.lit(0.0))).alias("chi_step"), r(F.col("high")).alias("bimodality"),
    )


__all__ = ["NOBODY", "cloud", "comments", "event_series", "paired_cloud", "series", "threads", "turns"]
