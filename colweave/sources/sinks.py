"""Result sinks (SNK-1, SNK-3, SNK-4): partitioned writes, never a driver-side file loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Write a result table (SNK-1); CSV gets a header."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_values_json(values_json: DataFrame, path: str) -> None:
    """Distinct values per column as JSON lines (SNK-3); floats are already text."""
    values_json.select("json").write.mode("overwrite").text(path)


def miss_log(preds: DataFrame, gt: DataFrame, details: str) -> DataFrame:
    """Ground-truth pairs the ranking missed, with the source's predicted list (SNK-4)."""
    lists = preds.groupBy("source").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("target").cast("string").alias("t")))), lambda s: s["t"]).alias("predicted")
    )
    found = preds.select("source", "target").withColumn("_f", F.lit(1))
    j = gt.join(lists, "source").join(found, ["source", "target"], "left").filter(F.col("_f").isNull())
    return j.select(F.lit(details).alias("details"), "source", "target", F.array_join("predicted", ", ").alias("predicted"))
