"""Unit tests for library functions that have no registered query."""

import math
import os
import tempfile

from pyspark.sql import functions as F


def test_cosine_and_normalize(spark):
    from colweave.operators.similarity import cosine_expr, normalize_expr

    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    r = df.select(cosine_expr("a", "b").alias("c"), normalize_expr("a").alias("n")).first()
    assert math.isclose(r["c"], 24.0 / 25.0)
    assert [round(x, 12) for x in r["n"]] == [0.6, 0.8]


def test_csv_catalogue_strips_headers_and_reads_many_files(spark):
    from colweave.sources import files
    from colweave.sources.catalog import cells, read_csv_table

    d = tempfile.mkdtemp(prefix="cw-csv-")
    for i in range(2):
        with open(os.path.join(d, f"part{i}.csv"), "w") as f:
            f.write(" id , name \n1,a\n2,b\n")
    t = read_csv_table(spark, os.path.join(d, "part0.csv"), "t")
    assert t.df.columns == ["id", "name"]
    assert cells([t], clean=False).count() == 4
    both = files.read_csv(spark, os.path.join(d, "*.csv"))  # many files, one scan
    assert both.count() == 4


def test_write_table(spark):
    from colweave.sources.sinks import write_table

    path = os.path.join(tempfile.mkdtemp(prefix="cw-out-"), "res")
    df = spark.createDataFrame([("m", 1.0)], "method string, mrr double")
    write_table(df, path, fmt="csv", partition_by=["method"])
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 1 and "method" in back.columns


def test_merge_judgements(spark):
    from colweave.operators.llm import merge_judgements

    m = spark.createDataFrame(
        [("s", "a", "t", "x", 0.9), ("s", "a", "t", "y", 0.8), ("s", "b", "t", "x", 0.7)],
        "src_table string, src_col string, tgt_table string, tgt_col string, score double",
    )
    r = spark.createDataFrame(
        [("s", "a", "t", 'Response: [{"column": "y", "score": 0.95}, {"column": "x"}]'), ("s", "b", "t", "no json here")],
        "src_table string, src_col string, tgt_table string, response string",
    )
    got = {(x["src_col"], x["tgt_col"]): (x["score"], x["rank"]) for x in merge_judgements(m, r).collect()}
    assert got[("a", "y")] == (0.95, 1) and got[("a", "x")] == (0.0, 2)
    assert got[("b", "x")] == (0.7, 1)  # unparsable response keeps the old scores


def test_augmentation_json_round_trip(spark):
    from colweave.operators.traindata import augmentation_map, read_augmentation

    aug = spark.createDataFrame(
        [("c", "original", "c", ["v1", "v2"]), ("c", "exact", "c_1", ["v1"])],
        "col_name string, kind string, name string, values array<string>",
    )
    back = read_augmentation(augmentation_map(aug))
    rows = {(r["col_name"], r["kind"], r["name"]): r["values"] for r in back.collect()}
    assert rows[("c", "original", "c")] == ["v1", "v2"] and rows[("c", "exact", "c_1")] == ["v1"]
