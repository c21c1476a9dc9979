"""Distinct ratios from mergeable sketches, counted exactly only near a threshold (AGG-2).

Every append of rows adds one HyperLogLog sketch and one row count for each
column, a few kilobytes whatever the rows. Sketches of all appends are united,
so a column's ratio is known without a second look at its values. Only where the
threshold lies within the estimate's error band are the values counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import COL_KEYS

#: log2 of a sketch's registers. The standard error of a union is 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Width of the error band in standard errors.
SIGMAS = 5.0
SKETCH_SCHEMA = "table_id string, col_name string, col_pos int, kind string, n_rows long, sketch binary"


def column_sketches(cells: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """``(table_id, col_name, col_pos, kind, n_rows, sketch)`` of one append; null cells count as rows alone."""
    return cells.groupBy(*COL_KEYS).agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg("value", lg_k).alias("sketch"))


def merged_sketches(parts: DataFrame) -> DataFrame:
    """Sketches of several appends as one for each column."""
    return parts.groupBy(*COL_KEYS).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("sketch").alias("sketch"))


def distinct_decisions(merged: DataFrame, cells: DataFrame, threshold: float = 0.8, lg_k: int = LG_K) -> DataFrame:
    """``(table_id, col_name, col_pos, kind, n_rows, estimate, n_distinct, over)``: whether distinct values exceed ``threshold`` of the rows.

    ``n_distinct`` is exact and only there for columns whose band holds the
    threshold; ``cells`` has the rows of all appends and is filtered to those columns.
    """
    band = SIGMAS * 1.04 / 2 ** (lg_k / 2)
    limit = F.lit(threshold) * F.col("n_rows")
    asked = merged.select(*COL_KEYS, "n_rows", F.hll_sketch_estimate("sketch").alias("estimate")).withColumn(
        "_near", F.col("estimate").between(limit / (1 + band) - 1, limit / (1 - band) + 1))
    near = asked.filter("_near").select("table_id", "col_name")
    values = cells.filter(F.col("value").isNotNull()).join(near, ["table_id", "col_name"], "left_semi")
    exact = values.groupBy("table_id", "col_name", "value").agg(F.lit(1).alias("_one")).groupBy("table_id", "col_name").agg(F.count("_one").alias("_exact"))
    n = F.when(F.col("_near"), F.coalesce("_exact", F.lit(0)))
    return asked.join(exact, ["table_id", "col_name"], "left").select(
        *COL_KEYS, "n_rows", "estimate", n.alias("n_distinct"),
        (F.coalesce(n, F.col("estimate")) > limit).alias("over"))
