"""Positions in a total order within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut


def positions(df: DataFrame, group: str, order: list[Column], name: str = "pos") -> DataFrame:
    """Add 0-based positions of rows in ``order`` within ``group``; the order must be total.

    Rows are range-partitioned by group and order, so a group may spread over many tasks; each
    task numbers its stretch of a group, shifted by the sizes of the stretches before.
    """
    keys = [c.alias(f"__o{k}") for k, c in enumerate(order)]
    named = [f"__o{k}" for k in range(len(order))]
    flat = df.select("*", *keys).repartitionByRange(F.col(group), *[F.col(n) for n in named])
    flat = cut(flat.withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = flat.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, "__part").orderBy(*named)
    out = flat.withColumn(name, F.row_number().over(inside)).join(sizes.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g")) & (flat["__part"] == sizes["__part"]))
    return out.select(*df.columns, (F.col(name) - 1 + F.col("__before")).cast("long").alias(name))
