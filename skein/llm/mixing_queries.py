"""Queries over mixing sources (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.mixing import mix, report
from skein.llm.tokens import with_tokens
from skein.session import cut
from skein.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = with_tokens(docs, "doc_id", "text")
    return cut(docs.select("doc_id", "source").join(sizes, "doc_id"), "sizes")  # texts are tokenised once


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: one row per use of a document, in shuffled order."""
    return mix(_docs(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares wanted and reached."""
    docs, targets = _docs(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return report(docs, mix(docs, targets), targets)


QUERIES = {"p9_mixture": p9_mixture, "p9_report": p9_report}
