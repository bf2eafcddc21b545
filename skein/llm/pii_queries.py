"""Queries over personal information (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.pii import pii_types, replace_pii
from skein.sources.tables import table


def _texts(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """(source_table, rows of k, text): bodies, selftexts and every entry of the samples."""
    cards = table(spark, sf_dir, "persona_cards").select("author", F.explode("samples").alias("text"))
    return [
        ("comments", table(spark, sf_dir, "comments").select(F.col("id").alias("k"), F.col("body").alias("text"))),
        ("threads", table(spark, sf_dir, "threads").select(F.col("post_id").alias("k"), F.col("selftext").alias("text"))),
        ("persona_cards", cards.withColumnRenamed("author", "k")),
    ]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record and type of personal information in it."""
    out = None
    for name, rows in _texts(spark, sf_dir):
        part = pii_types(rows, "k", "text").select(
            F.lit(name).alias("source_table"), F.col("k").alias("record_id"), F.col("type").alias("pii_type")
        )
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def p2_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with placeholders in place of personal information."""
    out = None
    for name, rows in _texts(spark, sf_dir):
        part = replace_pii(rows, "k", "text").select(
            F.lit(name).alias("source_table"), F.col("k").alias("record_id"), "text",
            F.size("spans").alias("n_replaced"),
        )
        out = part if out is None else out.unionByName(part)
    return out.distinct()


QUERIES = {"p2_found": p2_found, "p2_replaced": p2_replaced}
