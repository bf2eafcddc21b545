"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts a group is cut into, so that no task sorts a whole group.
PARTS = 256


def rank_within(df: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """Add ``rank``, 0-based and without gaps within ``group``, in a fixed pseudo-random order.

    Each group is cut into PARTS by a hash of the keys; the parts are numbered on their own and
    shifted by the sizes of the parts before, so a group may hold any share of all rows.
    """
    cut = df.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)))
    sizes = cut.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(group, "__part").orderBy(*keys)
    out = cut.withColumn("__inside", F.row_number().over(inside)).join(sizes, [group, "__part"])
    return out.withColumn("rank", F.col("__before") + F.col("__inside") - 1).drop("__part", "__before", "__inside")
