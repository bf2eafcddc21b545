"""Queries over packing documents into containers (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.packing import containers, pack
from skein.llm.tokens import with_tokens
from skein.sources.tables import table


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    rows = table(spark, sf_dir, "token_budgets").distinct().collect()  # one row per kind of container
    return {r["container_kind"]: int(r["capacity_tokens"]) for r in rows}


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing into train windows splits."""
    return p8_train_packed(spark, sf_dir).filter("n_pieces > 1").select("doc_id").distinct()


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document or piece with its container, both capacities permitted."""
    return pack(_sizes(spark, sf_dir), "doc_id", "n_tokens", list(_capacities(spark, sf_dir).values()))


def p8_train_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document or piece with its container, train windows only."""
    return pack(_sizes(spark, sf_dir), "doc_id", "n_tokens", [_capacities(spark, sf_dir)["train_window"]])


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of unused space by capacity."""
    caps = list(_capacities(spark, sf_dir).values())
    done = containers(p8_packed(spark, sf_dir), caps)
    return done.groupBy("capacity").agg(
        F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("used").alias("used"),
        (F.sum("unused") / F.sum("capacity")).alias("unused_share"),
    )


QUERIES = {"p8_found": p8_found, "p8_packed": p8_packed, "p8_train_packed": p8_train_packed, "p8_usage": p8_usage}
