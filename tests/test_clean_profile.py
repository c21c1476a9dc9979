"""Golden rows for cleaning, type detection and sampling semantics."""

from pyspark.sql import functions as F

from colweave.functions.clean import clean_header, clean_text, equal_name_key, is_number_text
from colweave.operators import profile as P
from colweave.operators import sampling as S
from colweave.sources.catalog import Table, cells


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_clean_text_golden(spark):
    cases = {
        "--": "  ",  # punctuation becomes spaces; only an empty result is null
        "12.5": "12 5",
        "2023-01-02": "2023 01 02",
        "-5": " 5",
        " NA ": "na",
        "NA": None,
        "camelCaseValue": "camel case value",
        "": None,
        "N/A": None,
        "Other": None,
    }
    for raw, want in cases.items():
        assert _one(spark, clean_text, raw) == want, raw


def test_header_and_equal_keys(spark):
    assert _one(spark, clean_header, "  customerID__Name ") == "customer id name"
    assert _one(spark, equal_name_key, " Cust-Name ") == "cust name"


def test_number_text_follows_pandas(spark):
    yes = [" 5 ", "1e3", "5.", "-.5", "inf", "Infinity", "+7"]
    no = ["5d", "NaN", "0x1f", "1_000", "12 5", "abc"]
    for v in yes:
        assert _one(spark, is_number_text, v) is True, v
    for v in no:
        assert _one(spark, is_number_text, v) is False, v


def _stats_for(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    t = Table("t", df, "rid", tuple(c for c in df.columns if c != "rid"))
    vc = P.value_counts(cells([t], clean=False), keep_null=True, clean=True)
    return {r["col_name"]: r for r in P.column_stats(vc).collect()}


def test_type_ladder(spark):
    rows = [(i, f"k{i}", "yes" if i % 2 else "no", "A" if i < 5 else "B", str(i), None, "red") for i in range(10)]
    st = _stats_for(spark, rows, "rid long, code_x string, flag string, grade string, num string, empty string, paid string")
    assert st["code_x"]["semantic_type"] == "key"          # distinct ratio 1.0
    assert st["flag"]["semantic_type"] == "binary"
    assert st["grade"]["semantic_type"] == "categorical"
    assert st["num"]["semantic_type"] == "numerical"
    assert st["empty"]["semantic_type"] == "unknown"
    assert st["paid"]["semantic_type"] == "key"            # ends with "id"
    assert st["num"]["inferred_dtype"] == "integer"
    assert st["empty"]["inferred_dtype"] == "unknown"


def test_samples_are_subsets_and_sorted(spark):
    rows = [(i, f"v{i % 37}") for i in range(500)]
    df = spark.createDataFrame(rows, "rid long, c string")
    t = Table("t", df, "rid", ("c",))
    vc = P.value_counts(cells([t], clean=False), clean=True)
    distinct = {r["value"] for r in vc.collect()}
    for mode in S.MODES:
        got = S.samples(vc, 10, mode).first()["samples"]
        assert len(got) <= 10 and set(got) <= distinct, mode
        if mode in ("mixed",):
            assert got == sorted(got)


def test_mixed_spacing_matches_rule(spark):
    # 25 distinct values in first-appearance order; n=10 -> 5 frequent + every 5th of 25
    rows = [(i, f"x{i:02d}") for i in range(25)] + [(100 + i, "x24") for i in range(5)]
    df = spark.createDataFrame(rows, "rid long, c string")
    t = Table("t", df, "rid", ("c",))
    vc = P.value_counts(cells([t], clean=False), clean=True)
    got = S.samples(vc, 10, "mixed").first()["samples"]
    freq = ["x24", "x00", "x01", "x02", "x03"]
    diverse = ["x00", "x05", "x10", "x15", "x20"]
    assert got == sorted(set(freq + diverse))


def test_small_columns_return_all_values(spark):
    rows = [(i, ["b", "a", "c"][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "rid long, c string")
    t = Table("t", df, "rid", ("c",))
    vc = P.value_counts(cells([t], clean=False), clean=True)
    for mode in S.MODES:
        assert S.samples(vc, 10, mode).first()["samples"] == ["a", "b", "c"]
