"""Positions in a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """``df`` with its 0-based position in ``order``.

    Rows are dealt into ranges of the order and ranked within their range; the
    ranges' counts, one row for each, give every range its first position. The
    ranges are written to the checkpoint folder before they are counted, so
    positions and counts come from the same split.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges only
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_range").orderBy(*order)
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.row_number().over(within) - 1).drop("_range", "_start")
