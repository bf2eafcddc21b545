"""Queries over markup residue (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.markup import strip_markup, with_markup
from skein.llm.pages import first_link, without_shared
from skein.sources.tables import table

SOURCES = (("comments", "id", "body"), ("threads", "post_id", "selftext"))


def _each(spark: SparkSession, sf_dir: str, run) -> DataFrame:
    parts = []
    for name, key, text in SOURCES:
        part = run(table(spark, sf_dir, name), key, text)
        rest = [c for c in part.columns if c != key]
        parts.append(
            part.select(F.lit(name).alias("source_table"), F.col(key).alias("record_id"), *rest)
        )
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text holds HTML, Markdown, wiki or LaTeX markup."""
    return _each(spark, sf_dir, with_markup).select("source_table", "record_id").distinct()


def p5_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's text without markup, in one plain notation."""
    return _each(spark, sf_dir, strip_markup).withColumn("kinds", F.array_join("kinds", ",")).distinct()


def p5_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every record the lines it shares with the record whose first link is nearest by URL path on the host."""

    def run(rows: DataFrame, key: str, text: str) -> DataFrame:
        host, path = first_link(text)
        pages = rows.select(key, text, host.alias("host"), path.alias("path")).distinct()
        return without_shared(pages, key, "host", "path", text).select(key, "n_lines", "n_shared")

    return _each(spark, sf_dir, run)


QUERIES = {"p5_found": p5_found, "p5_clean_text": p5_clean_text, "p5_page_lines": p5_page_lines}
