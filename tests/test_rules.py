"""Rules that the driver tables do not exercise: cell text, CSV types, judge answers, orders, assignment."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colweave.operators.candidates import equal_name_candidates
from colweave.operators.llm import merge_judgements, parse_response
from colweave.operators.ordering import global_index
from colweave.operators.rerank import greedy_one_to_one, hungarian_max
from colweave.operators import topk
from colweave.operators.similarity import sparse_topk, tfidf_vectors
from colweave.operators import similarity
from colweave.operators.traindata import balanced_batches
from colweave.sources.catalog import Table, cells, columns_relation, float_text, read_csv_table
from colweave.streaming.resultlog import read_results


@pytest.mark.parametrize("value", [
    0.0, -0.0, 1.0, 12.5, 0.001, 0.0001, 0.00012345, 1e-05, 2.5e-07, 1e7, 12345678.9, 123456789012345.6, 1e15, 9999999999999998.0, 1e16, 1.5e22, -3e300, 1e-300,
    float("inf"), float("-inf")])
def test_float_text_is_csv_text(spark, value):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(float_text(F.col("x"))).first()[0] == repr(value)


def test_float_text_of_short_floats_and_nan(spark):
    df = spark.createDataFrame([(0.1,), (1.5e7,), (float("nan"),), (None,)], "x float")
    assert [r[0] for r in df.select(float_text(F.col("x"))).collect()] == ["0.1", "15000000.0", None, None]


def test_csv_nulls_and_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        " whole ,gaps,num,flag,text,none\n1,1,1.5,True,a,NA\n 2,NA,-2e3,False,null,\n3,3,n/a,True,<NA>,#N/A\n")
    t = read_csv_table(spark, str(tmp_path / "t.csv"))
    assert [(f.name, f.dataType.simpleString()) for f in t.df.schema.fields] == [
        ("whole", "bigint"), ("gaps", "double"), ("num", "double"), ("flag", "boolean"), ("text", "string"), ("none", "string")]
    assert [tuple(r) for r in t.df.collect()] == [
        (1, 1.0, 1.5, True, "a", None), (2, None, -2000.0, False, None, None), (3, 3.0, None, True, None, None)]
    shown = {(r["row_id"], r["col_name"]): r["value"] for r in cells([Table("t", t.df, "whole")], clean=False).collect()}
    assert shown[(1, "gaps")] == "1.0" and shown[(2, "num")] == "-2000.0" and shown[(2, "gaps")] is None


def test_row_keys_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, 65535, "a"), (2, 0, "b")], "k long, n long, v string")
    ids = [r[0] for r in df.select(Table("t", df, ("k", "n")).row_id()).collect()]
    assert ids == [65536 + 65535, 2 * 65536]
    late = spark.createDataFrame([(1, 65536, "a")], "k long, n long, v string")
    with pytest.raises(Exception, match="row key does not fit"):
        late.select(Table("t", late, ("k", "n")).row_id()).collect()


def test_columns_without_values_are_matched_by_name(spark):
    a = spark.createDataFrame([(1, None)], "id long, shared string")
    b = spark.createDataFrame([(1, "x")], "key long, shared string")
    cols = columns_relation(spark, [Table("a", a), Table("b", b)])
    pairs = spark.createDataFrame([("a", "b")], "src_table string, tgt_table string")
    assert [(r["src_col"], r["tgt_col"]) for r in equal_name_candidates(cols, cols, pairs).collect()] == [("shared", "shared")]


ANSWERS = [
    ('[{"column": "a", "score": 0.9}, {"column": "b", "score": "0.5"}]', [("a", 0.9), ("b", 0.5)]),
    ('Sure: [{"column": "a"}] done', [("a", 0.0)]),
    ('[{"column": "a", "score": 0.9},]', [("a", 0.9)]),
    ('[{"column": "a", "score": 0.9}, {"column": "b", "sc', [("a", 0.9)]),
    ('[{"column": "a", "score": "high"}]', None),
    ('[{"column": "a", "score": 0.2}, {"column": "b", "score": null}]', None),
    ("no list", None),
    (None, None),
]


@pytest.mark.parametrize("text,want", ANSWERS)
def test_judge_answers(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parse_response(F.col("t"))).first()[0]
    assert (None if got is None else [(e["column"], e["score"]) for e in got]) == want


def test_unreadable_answers_keep_scores(spark):
    m = spark.createDataFrame([("s", "x", "t", "a", 0.4), ("s", "y", "t", "a", 0.3)], "src_table string, src_col string, tgt_table string, tgt_col string, score double")
    r = spark.createDataFrame([("s", "x", "t", ANSWERS[4][0]), ("s", "y", "t", ANSWERS[0][0])], "src_table string, src_col string, tgt_table string, response string")
    got = {(x["src_col"], x["tgt_col"]): x["score"] for x in merge_judgements(m, r).collect()}
    assert got == {("x", "a"): 0.4, ("y", "a"): 0.9, ("y", "b"): 0.5}


def test_log_that_cannot_be_read_is_not_empty(spark, tmp_path):
    assert read_results(spark, str(tmp_path / "none"), "method string").count() == 0
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        read_results(spark, str(tmp_path / "log"), "method string").count()


def test_global_index_counts_through_ranges(spark):
    values = [random.Random(1).randrange(50) for _ in range(400)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long")
    got = sorted((r["idx"], r["v"], r["i"]) for r in global_index(df, [F.col("v").desc(), F.col("i")]).collect())
    assert [(x[1], x[2]) for x in got] == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1]))
    assert [x[0] for x in got] == list(range(400))


@pytest.mark.parametrize("per_class", [1, 2, 3, 4])
def test_batches_are_full_and_distinct(spark, per_class):
    rows = [(i, i % 9) for i in range(90)] + [(1000 + i, 100 + i) for i in range(5)]  # five classes of one row
    df = spark.createDataFrame(rows, "id long, label long")
    batches = {}
    for r in balanced_batches(df, 12, per_class).collect():
        batches.setdefault(r["batch"], []).append((r["label"], r["id"]))
    assert len(batches) == len(rows) // 12
    for picked in batches.values():
        assert len(picked) == len({i for _, i in picked}) == 12
        assert len({c for c, _ in picked}) == 12 // per_class


def test_batches_that_cannot_be_filled_are_an_error(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, label long")
    with pytest.raises(ValueError):
        balanced_batches(df, 16, 2)


@pytest.mark.parametrize("shape", [(1, 1), (2, 5), (5, 3), (6, 6)])
def test_assignment_is_best(shape):
    w = np.random.default_rng(sum(shape)).integers(0, 9, shape) / 8
    got = hungarian_max(w)
    n, m = shape
    small, large = min(shape), max(shape)
    best = max(sum(w[i, p[i]] if n <= m else w[p[i], i] for i in range(small)) for p in itertools.permutations(range(large), small))
    assert len(got) == small and len({i for i, _ in got}) == small == len({j for _, j in got})
    assert math.isclose(sum(w[i, j] for i, j in got), best)


def test_greedy_selection_in_rounds(spark):
    rng = random.Random(5)
    rows = [("t", f"s{i}", i, "u", f"g{j}", j, rng.randrange(6) / 5) for i in range(14) for j in range(12) if rng.random() < 0.6]
    df = spark.createDataFrame(rows, "src_table string, src_col string, src_pos int, tgt_table string, tgt_col string, tgt_pos int, score double")
    want, used = [], set()
    for r in sorted(rows, key=lambda r: (-r[6], r[2], r[5])):
        if not used & {("s", r[1]), ("t", r[4])}:
            used |= {("s", r[1]), ("t", r[4])}
            want.append(r)
    assert sorted(tuple(r) for r in greedy_one_to_one(df).collect()) == sorted(want)


@pytest.mark.parametrize("n", [2, 3, 5])
@pytest.mark.parametrize("joined", [False, True])
def test_ngram_vectors_and_topk(spark, monkeypatch, n, joined):
    monkeypatch.setattr(topk, "BLOCK_NONZEROS", 60)
    monkeypatch.setattr(topk, "CELLS", 200)
    if joined:
        monkeypatch.setattr(similarity, "VOCABULARY", 3)
    rng = random.Random(n)
    texts = ["".join(rng.choices("abcé  \U0001f600", k=rng.randrange(0, 25))) for _ in range(40)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    vec = tfidf_vectors(df, "id", "t", n)
    import re
    from collections import Counter

    grams = {i: Counter(g[k : k + n] for k in range(len(g) - n + 1)) for i, g in ((i, re.sub(r"\s\s+", " ", t.lower())) for i, t in enumerate(texts) if t is not None)}
    freq = Counter(g for c in grams.values() for g in c)
    w = {i: {g: k * (math.log((1 + len(grams)) / (1 + freq[g])) + 1) for g, k in c.items()} for i, c in grams.items() if c}
    unit = {i: {g: x / math.sqrt(sum(y * y for y in v.values())) for g, x in v.items()} for i, v in w.items()}
    assert {r["id"]: len(r["terms"]) for r in vec.collect()} == {i: len(v) for i, v in unit.items()}
    got = {}
    for r in sparse_topk(vec, vec, 4, exclude_self=True).collect():
        got.setdefault(r["lid"], []).append((r["rank"], r["rid"], round(r["score"], 9)))
    want = {}
    for i, a in unit.items():
        scores = sorted(((-round(sum(x * b.get(g, 0) for g, x in a.items()), 12), j) for j, b in unit.items() if j != i))[:4]
        want[i] = [(k + 1, j, round(-s, 9)) for k, (s, j) in enumerate(scores)]
    assert {i: [x[2] for x in sorted(v)] for i, v in got.items()} == {i: [x[2] for x in v] for i, v in want.items()}
