"""Stores of vectors and results: reuse by content, seeds, reference means, sinks."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.vectors import doubles, finite
from skein.operators.contracts import demand
from skein.sources.embedders import embedded, provider, text_sha

#: A stored vector: whose it is, what text it was made of and by which provider.
VECTORS = "post_id string, side string, pos bigint, comment_id string, text_sha string, embedder string, emb array<float>"


def save_vectors(rows: DataFrame, path: str) -> None:
    """Write vectors as a table, the ones of a thread together; an earlier table is replaced when all is written."""
    names = [c.split()[0] for c in VECTORS.split(", ")]
    rows.select(*names).repartition("post_id", "side").sortWithinPartitions("post_id", "side", "pos").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)


def seeds(vectors: DataFrame, order: str = "post_id") -> DataFrame:
    """comment_id, embedder, emb: one vector for each comment, the first in ``order``."""
    return vectors.filter("comment_id is not null").groupBy("comment_id").agg(F.min_by(F.struct("embedder", "emb"), F.col(order)).alias("s")).select("comment_id", "s.*")


def vectors_of(rows: DataFrame, cfg: dict, store: DataFrame | None = None, seed: DataFrame | None = None) -> DataFrame:
    """rows (post_id, side, pos, comment_id, body) with text_sha, embedder, emb and origin.

    A side of a thread is stored if it has as many stored vectors as turns and all their texts are
    unchanged; then they are taken. Of other sides, human turns take the seed of their comment;
    what is left goes through the provider. Seeds of another provider raise ValueError.
    """
    rows = rows.withColumn("text_sha", text_sha(F.col("body")))
    name = provider(cfg)(cfg).name
    if store is None:
        got = rows.withColumns({"__emb": F.lit(None).cast("array<float>"), "__name": F.lit(None).cast("string")})
    else:
        kept = store.select("post_id", "side", "pos", F.col("text_sha").alias("__sha"), F.col("emb").alias("__emb"), F.col("embedder").alias("__name"))
        sizes = store.groupBy("post_id", "side").agg(F.count("*").alias("__m"))
        per = Window.partitionBy("post_id", "side")
        j = rows.join(kept, ["post_id", "side", "pos"], "left").join(sizes, ["post_id", "side"], "left")
        same = F.coalesce(F.min((F.col("__sha") == F.col("text_sha")).cast("int")).over(per), F.lit(0)) == 1
        same = same & (F.count("__sha").over(per) == F.count("*").over(per)) & (F.col("__m") == F.count("*").over(per))
        got = j.withColumn("__ok", same).withColumns({"__emb": F.when(F.col("__ok"), F.col("__emb")), "__name": F.when(F.col("__ok"), F.col("__name"))}).drop("__ok", "__sha", "__m")
    got = got.withColumn("origin", F.when(F.col("__emb").isNotNull(), "stored"))
    if seed is not None:
        other = seed.filter(F.col("embedder") != name).select("comment_id", "embedder")
        demand(other, "seeds of another embedder")
        got = got.join(seed.select("comment_id", F.col("emb").alias("__seed")), "comment_id", "left")
        use = F.col("__emb").isNull() & (F.col("side") == "human") & F.col("__seed").isNotNull()
        got = got.withColumns({"origin": F.when(use, "seeded").otherwise(F.col("origin")), "__emb": F.when(use, F.col("__seed")).otherwise(F.col("__emb")), "__name": F.when(use, F.lit(name)).otherwise(F.col("__name"))}).drop("__seed")
    columns = [*[c for c in rows.columns], "origin"]
    done = got.filter("__emb is not null").select(*columns, F.col("__name").alias("embedder"), F.col("__emb").alias("emb"))
    fresh = embedded(got.filter("__emb is null").select(*rows.columns), "body", cfg).withColumn("origin", F.lit("embedded"))
    return done.unionByName(fresh.select(*columns, "embedder", "emb"))


def reference_mean(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """One row, mu: a kept mean vector (.npy); ValueError unless it has ``dim`` finite numbers."""
    mu = np.load(path, allow_pickle=False)
    if mu.shape != (dim,) or not np.isfinite(mu).all():
        raise ValueError(f"{path}: {dim} finite numbers expected")
    return spark.createDataFrame([(mu.astype(float).tolist(),)], "mu array<double>")


def save_mean(mean: DataFrame, path: str) -> None:
    """Keep a mean vector (one row, array mu) as .npy of floats."""
    np.save(path, np.asarray(mean.select(doubles(F.col("mu")).alias("mu")).first()["mu"], np.float32))


def save_json(rows: DataFrame, path: str) -> None:
    """JSON lines, replaced as a whole once all is written; NaNs are kept as strings of that name."""
    rows.write.mode("overwrite").json(path)


def save_strict_json(rows: DataFrame, path: str, summary: dict | None = None, summary_path: str | None = None) -> None:
    """JSON lines without NaN or infinity: a number that is none raises ValueError before anything is written."""
    numbers = [f.name for f in rows.schema if f.dataType.typeName() in ("double", "float")]
    arrays = [f.name for f in rows.schema if f.dataType.simpleString() in ("array<double>", "array<float>")]
    bad = F.lit(False)
    for c in numbers:
        bad = bad | (F.col(c).isNotNull() & ~finite(F.col(c)))
    for c in arrays:
        bad = bad | F.exists(F.coalesce(c, F.array()), lambda x: x.isNotNull() & ~finite(x))
    if not rows.filter(bad).isEmpty():
        raise ValueError("a number is not finite")
    rows.write.mode("overwrite").json(path)
    if summary_path:
        with open(summary_path, "w", encoding="utf-8") as f:
            json.dump(summary or {}, f, allow_nan=False, ensure_ascii=False, indent=2, sort_keys=True)
