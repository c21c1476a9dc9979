"""Distinct decisions from sketches of several appends against exact counts."""

from pyspark.sql import functions as F

from colweave.operators import sketches

SIZE = 20000


def _cells(spark):
    """Columns with a share of distinct values given by their name, in percent; ``null`` has no values."""
    rows = spark.range(SIZE).withColumnRenamed("id", "row_id")
    shares = [2, 50, 78, 80, 81, 100]
    share = F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")
    some = rows.select("row_id", share).select(
        F.lit("t").alias("table_id"), "row_id", F.concat(F.lit("c"), "share").alias("col_name"), F.col("share").alias("col_pos"),
        F.lit("text").alias("kind"), F.concat(F.lit("v"), F.least(F.col("row_id"), (F.col("share") * SIZE / 100).cast("long") - 1)).alias("value"))
    empty = rows.select(F.lit("t").alias("table_id"), "row_id", F.lit("null").alias("col_name"), F.lit(0).alias("col_pos"), F.lit("text").alias("kind"),
                        F.lit(None).cast("string").alias("value"))
    return some.unionByName(empty)


def test_decisions_equal_exact_ones(spark):
    cells = _cells(spark)
    parts = [sketches.column_sketches(cells.filter(F.pmod("row_id", F.lit(3)) == i)) for i in range(3)]
    merged = sketches.merged_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    got = {r["col_name"]: r for r in sketches.distinct_decisions(merged, cells).collect()}
    assert {c for c, r in got.items() if r["over"]} == {"c81", "c100"}
    # exact where the band holds the threshold, from sketches alone elsewhere
    assert {c: r["n_distinct"] for c, r in got.items() if r["n_distinct"] is not None} == {"c78": 15600, "c80": 16000, "c81": 16200}
    assert all(r["n_rows"] == SIZE for r in got.values()) and got["null"]["estimate"] == 0


def test_few_rows_and_no_rows(spark):
    cells = _cells(spark).filter("row_id < 5")
    merged = sketches.merged_sketches(sketches.column_sketches(cells))
    got = {r["col_name"]: r["over"] for r in sketches.distinct_decisions(merged, cells).collect()}
    assert got["c100"] and not got["null"]
    none = cells.limit(0)
    assert sketches.distinct_decisions(sketches.merged_sketches(sketches.column_sketches(none)), none).count() == 0
