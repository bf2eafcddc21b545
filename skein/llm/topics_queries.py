"""Queries over groups of similar threads (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.residue import fit, mark
from skein.llm.topics import clusters
from skein.session import cut
from skein.sources.tables import table

#: Titles shown per group.
TYPICAL = 3


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each thread once, without titles that are residue."""
    titles = table(spark, sf_dir, "threads").filter("title is not null").groupBy("post_id").agg(F.max("title").alias("title"), F.max("subreddit").alias("subreddit"))
    titles = cut(titles, "threads")
    bad = mark(titles, "post_id", "title", fit(titles, "title")).filter("residue > 0").select("post_id")
    return titles.join(bad, "post_id", "left_anti")


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    titles = cut(_titles(spark, sf_dir), "titles")
    return titles, cut(clusters(titles, "post_id", "title"), "groups")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of threads about the same thing and the same question."""
    _, groups = _groups(spark, sf_dir)
    rows = groups.filter("thing is not null and question is not null").select("k", "thing", "question")
    a, b = rows.withColumnRenamed("k", "post_id_a"), rows.withColumnRenamed("k", "post_id_b")
    return a.join(b, ["thing", "question"]).filter("post_id_a < post_id_b").select("post_id_a", "post_id_b")


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of similar threads with its size, communities and most typical titles.

    Every title that is no residue is in one group: without a thing, that of its question; with nothing
    but a thing, that of the thing; with neither (no letters), that of the same title.
    """
    titles, groups = _groups(spark, sf_dir)
    same = F.concat(F.lit("title:"), F.trim(F.lower(F.regexp_replace("title", r"(?U)\s+", " "))))
    question = F.when(F.col("thing").isNull(), F.coalesce("question", same)).otherwise(F.col("question"))
    rows = groups.join(titles, groups["k"] == titles["post_id"]).withColumn("question", question)
    first = Window.partitionBy("thing", "question").orderBy(F.desc("density"), "post_id")
    top = rows.withColumn("r", F.row_number().over(first))
    return top.groupBy("thing", "question").agg(
        F.count("*").alias("size"), F.countDistinct("subreddit").alias("n_subreddits"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= TYPICAL, F.col("title")))), " | ").alias("typical"),
    )


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}
