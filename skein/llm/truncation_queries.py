"""Queries over texts cut off (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.truncation import detect
from skein.session import cut
from skein.sources.tables import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each simulated turn once: k, post_id, position, source, text."""
    turns = table(spark, sf_dir, "sim_comments").select("post_id", "position", F.col("response_model").alias("source"), F.col("body").alias("text"))
    turns = turns.dropDuplicates(["post_id", "position"])
    return turns.withColumn("k", F.concat_ws(":", "post_id", F.col("position").cast("string")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated turns whose body ends in the middle of a word or sentence."""
    turns = cut(_turns(spark, sf_dir), "turns")
    found = detect(turns).filter("truncated").select("k")
    return turns.join(found, "k").select("post_id", "position")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of incomplete turns for each response model."""
    turns = cut(_turns(spark, sf_dir), "turns")
    rows = turns.join(detect(turns).filter("truncated").select("k", "truncated"), "k", "left")
    return rows.groupBy(F.col("source").alias("response_model")).agg(
        F.count("*").alias("n_turns"), F.count("truncated").alias("n_truncated"),
        (F.count("truncated") / F.count("*")).alias("share"),
    )


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates}
