"""Queries over reply trees (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.hierarchy import descendants, fullname_id, hierarchies
from skein.sources.tables import table


def _nodes(spark: SparkSession, sf_dir: str, paths: bool) -> DataFrame:
    c = table(spark, sf_dir, "comments")
    parent = F.when(~F.col("parent_id").startswith("t3_"), fullname_id(F.col("parent_id")))
    return hierarchies(c, F.col("post_id"), F.col("id"), parent, paths)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments whose chain of parents runs into a circle."""
    nodes = _nodes(spark, sf_dir, paths=False)
    return nodes.filter(F.col("cycle_id").isNotNull()).select("id", "cycle_id")


def p6_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every comment."""
    nodes = _nodes(spark, sf_dir, paths=True)
    return nodes.select(
        F.col("scope").alias("post_id"), "id", F.array_join("path", "/").alias("path"), "depth",
        "root", "n_descendants", "cycle_id", "back_edge", F.array_join("below", "/").alias("below"),
    )


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a comment and a comment below it, with their distance."""
    return descendants(_nodes(spark, sf_dir, paths=True)).withColumnRenamed("scope", "post_id")


QUERIES = {"p6_found": p6_found, "p6_hierarchy": p6_hierarchy, "p6_descendants": p6_descendants}

_CHAIN = """
WITH RECURSIVE c AS (
  SELECT DISTINCT post_id, id,
    CASE WHEN parent_id LIKE 't3\\_%' ESCAPE '\\' THEN NULL
         ELSE CASE WHEN contains(parent_id, '_') THEN substr(parent_id, strpos(parent_id, '_') + 1) ELSE parent_id END END AS parent FROM comments),
e AS (
  SELECT c.post_id, c.id, p.id AS parent FROM c
  LEFT JOIN c p ON p.post_id = c.post_id AND p.id = c.parent AND c.parent <> c.post_id),
tree AS (
  SELECT post_id, id, id AS path, id AS root, CAST(0 AS BIGINT) AS depth FROM e WHERE parent IS NULL
  UNION ALL
  SELECT e.post_id, e.id, t.path || '/' || e.id, t.root, t.depth + 1
  FROM tree t JOIN e ON e.post_id = t.post_id AND e.parent = t.id)
"""

ORACLES = {
    "p6_found": _CHAIN
    + """,
open AS (SELECT e.* FROM e ANTI JOIN tree USING (post_id, id)),
walk AS (
  SELECT id AS start, parent AS cur, 1 AS step FROM open
  UNION ALL
  SELECT w.start, o.parent, w.step + 1 FROM walk w JOIN open o ON o.id = w.cur
  WHERE w.step <= (SELECT count(*) FROM open)),
circle AS (SELECT DISTINCT start AS id FROM walk WHERE cur = start),
reach AS (SELECT w.start AS id, min(w.cur) AS cycle_id FROM walk w
          JOIN circle ON circle.id = w.cur GROUP BY 1)
SELECT id, cycle_id FROM reach""",
    "p6_descendants": _CHAIN
    + """,
open AS (SELECT e.* FROM e ANTI JOIN tree USING (post_id, id)),
walk AS (
  SELECT id AS start, parent AS cur, 1 AS step FROM open
  UNION ALL
  SELECT w.start, o.parent, w.step + 1 FROM walk w JOIN open o ON o.id = w.cur
  WHERE w.step <= (SELECT count(*) FROM open)),
circle AS (SELECT DISTINCT start AS id FROM walk WHERE cur = start),
down AS (SELECT * FROM e WHERE parent IS NOT NULL AND id NOT IN (FROM circle) AND parent NOT IN (FROM circle)),
up AS (
  SELECT post_id, parent AS id, id AS descendant_id, CAST(1 AS BIGINT) AS distance FROM down
  UNION ALL
  SELECT u.post_id, d.parent, u.descendant_id, u.distance + 1
  FROM up u JOIN down d ON d.post_id = u.post_id AND d.id = u.id)
SELECT post_id, id, descendant_id, distance FROM up""",
}
