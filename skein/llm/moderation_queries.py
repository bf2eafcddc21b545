"""Queries over abusive, hateful and sexual content (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.moderation import score
from skein.sources.tables import table

#: Probability from which a record is reported.
REPORT_FROM = 0.5


def _scores(spark: SparkSession, sf_dir: str, detail: bool) -> DataFrame:
    key = lambda name, c: F.concat_ws("\t", F.lit(name), c)
    turn = F.concat_ws(":", "post_id", F.col("position").cast("string"))
    comments = table(spark, sf_dir, "comments").select(key("comments", F.col("id")).alias("k"), F.col("body").alias("text"))
    sims = table(spark, sf_dir, "sim_comments").select(key("sim_comments", turn).alias("k"), F.col("body").alias("text"))
    labels = table(spark, sf_dir, "moderation_labels").select(
        F.concat_ws("\t", "source_table", "record_id").alias("k"), "rater", "rating"
    )
    out = score(comments.unionByName(sims), labels, detail)
    part = F.split("k", "\t", 2)
    return out.select(part[0].alias("source_table"), part[1].alias("record_id"), "score", "evidence", "similarity")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that insult, threaten, hate or are sexually explicit."""
    hits = _scores(spark, sf_dir, detail=False).filter(F.col("score") >= REPORT_FROM)
    return hits.select("source_table", "record_id").distinct()


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every record, with its evidence."""
    rows = _scores(spark, sf_dir, detail=True)
    return rows.groupBy("source_table", "record_id").agg(
        F.max("score").alias("score"), F.max_by("evidence", "score").alias("evidence")
    )


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of reported records for each subreddit (comments) and response model (sim_comments)."""
    found = p4_found(spark, sf_dir)
    threads = table(spark, sf_dir, "threads").groupBy("post_id").agg(F.max("subreddit").alias("source"))
    comments = table(spark, sf_dir, "comments").select("post_id", F.col("id").alias("record_id")).distinct()
    sims = table(spark, sf_dir, "sim_comments").select(
        F.concat_ws(":", "post_id", F.col("position").cast("string")).alias("record_id"),
        F.col("response_model").alias("source"),
    ).distinct()
    rows = comments.join(threads, "post_id", "left").select(F.lit("comments").alias("source_table"), "record_id", "source")
    rows = rows.unionByName(sims.select(F.lit("sim_comments").alias("source_table"), "record_id", "source"))
    rows = rows.join(found.withColumn("hit", F.lit(1)), ["source_table", "record_id"], "left")
    return rows.groupBy("source_table", "source").agg(
        F.count("*").alias("n_records"), F.count("hit").alias("n_reported"), (F.count("hit") / F.count("*")).alias("rate")
    )


QUERIES = {"p4_found": p4_found, "p4_scores": p4_scores, "p4_rates": p4_rates}
