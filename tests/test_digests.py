"""Value counts by digest against counts by text, on short, long, null and nearly equal values."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colweave.operators import digests as D
from colweave.operators import profile as P
from colweave.operators import sampling as S
from colweave.sources.catalog import Table, cells, read_table


def _table(spark, order_key="k"):
    draw = random.Random(3)
    stem = "The same beginning of many long values, "
    values = [None, "", "nan", "x" * 32, "x" * 33, "AbCdEf" * 5, "aB" * 16, "aB" * 17, "0" * 40 + "7", " 2024-01-31" + " " * 30, "İ" * 17, "(((" * 12 + "nan"]
    values += [stem + w for w in ("One", "one", "two", "Three", "four")] + [f"{stem}{i}" for i in range(30)] + [f"v{i}" for i in range(30)]
    rows = [(i, draw.choice(values), draw.choice([1.5, None, 2.0]), draw.randrange(40)) for i in range(600)]
    rows += [(None, "a long value in a row that has no number of its own", 1.0, 1)] * 3 + [(5, stem + "repeated row", 1.0, 1)] * 2
    df = spark.createDataFrame(rows, "k long, text string, price double, n int")
    return Table("t", df, order_key, ("text", "price", "n"))


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("clean", [False, True])
@pytest.mark.parametrize("by_row", [False, True])
def test_counts_match_counts_by_text(spark, clean, by_row):
    raw = cells([_table(spark)], clean=False)
    want = P.value_counts(raw, clean=clean)
    got = D.value_counts(raw, clean, by_row)
    assert _rows(got.select(*want.columns)) == _rows(want)


@pytest.mark.parametrize("clean", [False, True])
def test_statistics_match(spark, clean):
    raw = cells([_table(spark)], clean=False)
    want = P.column_stats(P.value_counts(raw, keep_null=True, clean=clean))
    assert _rows(P.column_stats(D.value_digests(raw, clean)).select(*want.columns)) == _rows(want)


@pytest.mark.parametrize("mode", S.MODES)
def test_samples_match(spark, mode):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents", ["source", "text"])
    for tab, clean, n in ((_table(spark), True, 7), (docs, False, 10)):
        raw = cells([tab], clean=False)
        want = S.samples(P.value_counts(raw, clean=clean), n, mode)
        got = D.samples(D.value_digests(raw, clean, seed=42), raw, n, mode, clean)
        assert _rows(got.select(*want.columns)) == _rows(want)


def test_empty_table(spark):
    tab = Table("t", spark.createDataFrame([], "k long, text string"), "k", ("text",))
    raw = cells([tab], clean=False)
    assert D.value_counts(raw, True).count() == 0
    assert D.samples(D.value_digests(raw), raw).count() == 0


def test_counting_shuffle_carries_no_long_text(spark):
    longest = D.value_digests(cells([_table(spark)], clean=False), clean=True)
    got = longest.selectExpr("max(octet_length(short)) s", "max(octet_length(digest)) d", "max(char_length(head)) h").first()
    assert got["s"] <= D.SHORT and got["d"] == 32 and got["h"] <= D.HEAD


@pytest.mark.parametrize("clean", [False, True])
@pytest.mark.parametrize("order_key", ["k", None])
def test_columns_counted_before_they_are_text(spark, clean, order_key):
    import datetime as dt
    from decimal import Decimal

    draw = random.Random(4)
    pools = [[0.0, -0.0, float("nan"), None, 1e16, 1.5, float("-inf")], [Decimal("1.50"), Decimal("0.00"), None], [True, False, None],
             [dt.date(2024, 1, 31), None], [dt.datetime(2024, 1, 31, 1, 2, 3), dt.datetime(2024, 1, 31), None], [1, 2, None], [3, None], ["Ab", "nan", None, "x" * 40]]
    rows = [(i if i % 50 else None, *(draw.choice(p) for p in pools), draw.choice(pools[0])) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, d double, m decimal(10,2), b boolean, y date, t timestamp, i int, l long, s string, f float")
    tab = Table("t", df, order_key)
    want = D.value_digests(cells([tab], clean=False), clean, seed=42)
    got = D.table_digests([tab], clean, seed=42)
    if order_key is None:
        want, got = want.drop("first_row"), got.drop("first_row")
    assert _rows(got.select(*want.columns)) == _rows(want)
    numbers = Table("n", df.select("k", "i"), "k")
    assert _rows(D.table_digests([numbers], clean).select(*want.columns[:2])) == _rows(D.value_digests(cells([numbers], clean=False), clean).select(*want.columns[:2]))


def test_counting_code_compiles(spark):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        raw = cells([read_table(spark, "/root/testdata/sf0.001", t) for t in ("part", "events")], clean=False)
        assert D.value_digests(raw, clean=True, seed=42).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


@pytest.mark.parametrize("key", ["id * 7919 % 20011 + 0.5D", "-1D", "CAST(id % 3 AS DOUBLE)", "CASE WHEN id < 4 THEN -5D ELSE -1D END"])
def test_sample_candidates_are_few_and_hold_the_first(spark, key):
    vd = spark.range(20000).selectExpr(
        "'t' table_id", "IF(id % 5 = 0, 'a', 'b') col_name", "concat('v', id * 31 % 20000) short", "CAST(NULL AS STRING) digest", f"{key} _key")
    vd = vd.withColumn("_head", F.substring("short", 1, D.HEAD)).unionByName(
        spark.sql("SELECT 't' table_id, 'c' col_name, 'one' short, CAST(NULL AS STRING) digest, 0D _key, 'one' _head"))
    first = F.rank().over(Window.partitionBy("table_id", "col_name").orderBy("_key", "_head"))
    near = D._foremost(vd, 10, ties=True).select(*vd.columns)
    assert _rows(near.withColumn("r", first).filter("r <= 10")) == _rows(vd.withColumn("r", first).filter("r <= 10"))
    assert near.count() < 200


def test_spread_picks_without_ranking_all(spark):
    vd = spark.range(9000).selectExpr("'t' table_id", "concat('c', id % 3) col_name", "CAST(id AS STRING) short", "CAST(NULL AS STRING) digest",
                                      "CASE WHEN id % 11 = 0 THEN NULL WHEN id = 7 THEN 1L << 60 WHEN id = 8 THEN -(1L << 59) ELSE (id * 7919 % 9001) DIV 2 * 65536 END first_row")
    vd = S._with_n_distinct(vd)
    for parts, width in ((5, 1 << 20), (7, 1), (1, 1 << 30)):
        step = F.greatest(F.lit(1), F.floor(F.col("n_distinct") / parts))
        want = S.first_appearance_rank(vd, width).filter((F.pmod("appear_rank", step) == 0) & (F.col("appear_rank") < step * parts)).drop("appear_rank")
        assert _rows(S.evenly_spread(vd, parts, width)) == _rows(want.select(*vd.columns))
