"""Span and marker pooling on a hand-built token table."""

import math

from colweave.operators.pooling import marker_pool, span_pool


def _tokens(spark):
    rows = [
        (1, 0, 0, 0, [1.0, 0.0], False),   # CLS, zero length
        (1, 1, 0, 5, [1.0, 0.0], True),
        (1, 2, 6, 10, [0.0, 1.0], False),
        (1, 3, 11, 15, [0.0, 3.0], True),
        (2, 0, 0, 0, [0.0, 2.0], False),
        (2, 1, 0, 4, [5.0, 0.0], False),
    ]
    return spark.createDataFrame(rows, "item_id long, tok_idx int, start int, end int, vec array<double>, is_marker boolean")


def test_span_pool_mean_and_fallback(spark):
    spans = spark.createDataFrame([(1, 6, 15), (2, 20, 30)], "item_id long, span_start int, span_end int")
    got = {r["item_id"]: r for r in span_pool(_tokens(spark), spans, "first").collect()}
    assert not got[1]["missing"]
    assert math.isclose(got[1]["vec"][0], 0.0) and math.isclose(got[1]["vec"][1], 1.0)
    assert got[2]["missing"] and got[2]["vec"] == [0.0, 1.0]
    strict = {r["item_id"]: r for r in span_pool(_tokens(spark), spans, "error").collect()}
    assert strict[2]["vec"] is None


def test_marker_pool(spark):
    ords = spark.createDataFrame([(1, 1), (2, 0)], "item_id long, marker_ordinal int")
    got = {r["item_id"]: r for r in marker_pool(_tokens(spark), ords, "first").collect()}
    assert got[1]["vec"] == [0.0, 1.0] and not got[1]["missing"]
    assert got[2]["missing"]
