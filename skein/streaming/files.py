"""Streams from and to files: dumps as they arrive, sinks that repeat no row, results kept by content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.sources.readers import DUMP


def dump_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Lines of dumps (post, comments) as files appear in a folder, at most ``files`` at a time."""
    return spark.readStream.schema(DUMP).option("maxFilesPerTrigger", files).json(folder).filter("post is not null")


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append rows to a table of parquet files, each key once in a trigger and no trigger twice.

    Each trigger writes a folder of its own, which a repeated trigger replaces; the query stops
    when all that is there has been read.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/trigger={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fingerprint(settings: str, *columns: str):
    """SHA-256 of the settings and of columns: equal only where content and settings are."""
    return F.sha2(F.to_json(F.struct(F.lit(settings).alias("settings"), *[F.col(c) for c in columns])), 256)


def upsert(spark: SparkSession, path: str, fresh: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], n: int) -> DataFrame:
    """Results of ``fresh`` (key, print, ...): kept ones whose fingerprint holds, others computed anew.

    Kept results lie under ``path``/version=<n - 1> and the new whole under version=<n>, so that a run
    that fails leaves the earlier one as it was. ``compute`` gives key, print and results.
    """
    try:
        kept = spark.read.parquet(f"{path}/version={n - 1}")
    except Exception:  # noqa: BLE001 - there is no earlier version
        kept = None
    if kept is None:
        out = compute(fresh)
    else:
        good = kept.join(fresh.select(key, "print"), [key, "print"], "left_semi")
        out = good.unionByName(compute(fresh.join(good.select(key), key, "left_anti")))
    out.write.mode("overwrite").parquet(f"{path}/version={n}")
    return spark.read.parquet(f"{path}/version={n}")


RESUMED = "key string, position long, body string"


def resumable_turns(stream: DataFrame, generate: Callable[[str, int], str]) -> DataFrame:
    """key, position, body: turns of threads generated one after the other, going on where they stopped.

    stream: key, n (turns wanted so far). State per thread is the number of turns made; a thread that
    is asked for again with a greater n goes on there. ``generate(key, position)`` must be picklable.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else 0
        wanted = max((int(f["n"].max()) for f in frames if len(f)), default=0)
        rows = [(key[0], k, generate(key[0], k)) for k in range(done, wanted)]
        state.update((max(done, wanted),))
        yield pd.DataFrame(rows, columns=["key", "position", "body"])

    slim = stream.select(F.col("key").cast("string").alias("key"), F.col("n").cast("long").alias("n"))
    return slim.groupBy("key").applyInPandasWithState(step, RESUMED, "done long", "append", GroupStateTimeout.NoTimeout)
