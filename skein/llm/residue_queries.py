"""Queries over template residue, filler and notices (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.residue import fit, mark
from skein.sources.tables import table

SOURCES = (("comments", "id", "body"), ("threads", "post_id", "title"))


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, record_id, residue, kind, ratio) of every comment and thread title."""
    parts = [
        table(spark, sf_dir, name).select(
            F.lit(name).alias("source_table"), F.col(key).alias("record_id"), F.col(text).alias("t")
        )
        for name, key, text in SOURCES
    ]
    texts = parts[0].unionByName(parts[1]).filter(~F.col("t").isin("[deleted]", "[removed]"))
    model = fit(texts, "t")
    keyed = texts.withColumn("k", F.concat_ws("\t", "source_table", "record_id"))
    out = mark(keyed, "k", "t", model)
    cols = F.split("k", "\t", 2)
    return out.select(
        cols[0].alias("source_table"), cols[1].alias("record_id"), "residue", "kind", "ratio"
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and thread titles that are residue, wholly or in part."""
    return marked(spark, sf_dir).filter("residue > 0").select("source_table", "record_id").distinct()


def p3_kept_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discussion without its residue: post and id of the comments that stay."""
    bad = p3_found(spark, sf_dir).filter("source_table = 'comments'").select("record_id")
    comments = table(spark, sf_dir, "comments").select("post_id", "id").distinct()
    return comments.join(bad, comments["id"] == bad["record_id"], "left_anti")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, residue records and their share by table and class."""
    rows = marked(spark, sf_dir).groupBy("source_table", "record_id").agg(F.max("kind").alias("kind"))
    total = rows.groupBy("source_table").agg(F.count("*").alias("n_records"))
    kinds = rows.filter("kind is not null").groupBy("source_table", "kind").agg(F.count("*").alias("n"))
    return kinds.join(F.broadcast(total), "source_table").withColumn("share", F.col("n") / F.col("n_records"))


QUERIES = {"p3_found": p3_found, "p3_kept_comments": p3_kept_comments, "p3_rates": p3_rates}
