"""Windows by count and by event time over streams of rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COUNT_SCHEMA = "key string, win long, n long, mean double"


def count_windows(stream: DataFrame, key: str, order: str, value: str, size: int = 10) -> DataFrame:
    """key, win, n, mean: a row per key and full window of ``size`` values, as soon as it is full.

    State per key is the open window only: its number and at most ``size`` - 1 values. Rows of one
    trigger are taken in ``order``; null values are skipped.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        win, held = state.get if state.exists else (0, [])
        held, out = list(held), []
        rows = pd.concat(list(frames)).dropna(subset=["value"]).sort_values("order")
        for v in rows["value"]:
            held.append(float(v))
            if len(held) == size:
                out.append((group[0], win, size, sum(held) / size))
                win, held = win + 1, []
        state.update((win, held))
        yield pd.DataFrame(out, columns=["key", "win", "n", "mean"])

    slim = stream.select(F.col(key).cast("string").alias("key"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    return slim.groupBy("key").applyInPandasWithState(step, COUNT_SCHEMA, "win long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def time_windows(stream: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, key, n, mean: tumbling event-time windows; rows later than ``late`` are dropped."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), F.col(key).alias("key"))
    return w.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), "key", "n", "mean")
