"""Queries over texts that look the same (problem 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.visual import look_alike_pairs, unify
from skein.sources.tables import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that differ in code points but look the same."""
    return look_alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in the consistent form."""
    return unify(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p10_found": p10_found, "p10_unified": p10_unified}
