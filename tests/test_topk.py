"""Top-k retrieval by bounded blocks against all pairs."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from colweave.operators import topk
from colweave.operators.similarity import dense_block_apply, dense_topk, sparse_topk


@pytest.fixture(params=[0, 8])
def direct(request, monkeypatch):
    """Blocks up to which all are scored: none, and as it is."""
    monkeypatch.setattr(topk, "DIRECT", request.param)


def brute(left, right, k, exclude_self=False, threshold=None, groups=("",)):
    """(id, group, vector) rows -> {(lid, group): [(rid, score)]}."""
    out = {}
    for lid, own, x in left:
        for g in groups:
            found = []
            for rid, other, y in right:
                if other != g or (exclude_self and lid == rid) or (len(groups) > 1 and own == g):
                    continue
                n = np.linalg.norm(x) * np.linalg.norm(y)
                s = round(float(np.dot(x, y) / n), 12) if n else 0.0
                if threshold is None or s >= threshold:
                    found.append((-s, rid))
            if found:
                out[lid, g] = [(rid, -s) for s, rid in sorted(found)[:k]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault((r["lid"], r["rgroup"] if "rgroup" in r else ""), []).append((r["rid"], r["score"]))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [r for r, _ in got[q]] == [r for r, _ in rows], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in rows], atol=1e-9)


def vectors(seed, n, spread, dim=6, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    x[0] = 0  # no direction
    x[1] = x[2] = x[3]  # ties
    return x


@pytest.mark.parametrize("spread,k", [(0.02, 3), (3.0, 5), (0.3, 40)])
def test_dense_blocks_give_all_pairs(spark, direct, spread, k):
    x = vectors(5, 300, spread)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = found(r.asDict() | {"rgroup": ""} for r in dense_topk(df, df, k, exclude_self=True, block_rows=20).collect())
    rows = [(i, "", v) for i, v in enumerate(x)]
    same(got, brute(rows, rows, k, exclude_self=True))


def test_dense_groups_and_threshold(spark, direct):
    x = vectors(6, 240, 0.2)
    rows = [(i, "abc"[i % 3], v) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, g, v.tolist()) for i, g, v in rows], "id long, g string, vec array<double>")
    got = found(r.asDict() for r in dense_topk(df.select("id", "vec"), df, 4, threshold=0.5, exclude_self=True, right_group="g", block_rows=40).collect())
    want = {}
    for g in "abc":
        part = [r for r in rows if r[1] == g]
        want |= {(q, g): v for (q, _), v in brute([(i, "", v) for i, _, v in rows], [(i, "", v) for i, _, v in part], 4, True, 0.5).items()}
    same(got, want)


def test_equal_vectors_and_empty_sides(spark, direct):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(90)], "id long, vec array<double>")
    got = found(r.asDict() | {"rgroup": ""} for r in dense_topk(df, df, 3, exclude_self=True, block_rows=8).collect())
    assert {q: [r for r, _ in v] for (q, _), v in got.items()} == {i: [j for j in range(5) if j != i][:3] for i in range(90)}
    none = df.limit(0)
    assert dense_topk(none, df, 3).count() == 0 and dense_topk(df, none, 3).count() == 0


def test_few_queries_reach_most_blocks(spark, monkeypatch):
    x = vectors(7, 2000, 0.01, dim=8, centres=40)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    sent, blocks = [], []
    scored = topk._scored

    def counted(routed, right, *a):
        sent.append(routed.count())
        blocks.append(right.select("cell", "sub").distinct().count())
        return scored(routed, right, *a)

    monkeypatch.setattr(topk, "_scored", counted)
    assert dense_topk(df, df, 5, exclude_self=True, block_rows=20).count() == 5 * 2000
    assert blocks[0] >= 100 and sum(sent) / 2000 < 0.12 * blocks[0]


def sparse_rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        terms = sorted(rng.sample(range(-40, 400), rng.randrange(1, 9)) if i % 3 else [7, *rng.sample(range(500, 520), 3)])
        w = np.array([rng.random() + 0.1 for _ in terms])
        out.append((i, "xyz"[i % 3], terms, (w / np.linalg.norm(w)).tolist()))
    return out


@pytest.mark.parametrize("by_group", [False, True])
@pytest.mark.parametrize("summary", [4_000_000, 5_000])
def test_sparse_blocks_give_all_pairs(spark, direct, monkeypatch, by_group, summary):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "SUMMARY", summary)  # a small one: terms share numbers, bounds are wide
    rows = sparse_rows(3, 260)
    df = spark.createDataFrame(rows, "id long, g string, terms array<long>, weights array<double>")

    def dense(r):
        v = np.zeros(600)
        v[[t + 40 for t in r[2]]] = r[3]
        return r[0], r[1] if by_group else "", v

    dense_rows = [dense(r) for r in rows]
    monkeypatch.setattr(topk.blocked_topk, "__defaults__", (None, False, False, 40))
    got = found(r.asDict() for r in sparse_topk(df, df, 4, exclude_self=True, group_col="g" if by_group else None).collect())
    same(got, brute(dense_rows, dense_rows, 4, True, groups=tuple("xyz") if by_group else ("",)))


def test_tiles_of_a_block_keep_ties_and_small_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 7)
    monkeypatch.setattr(topk, "TILE_QUERIES", 5)
    x = np.round(vectors(8, 90, 1.0, dim=2), 1)
    rows = [(i * 7 % 90, "", v) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v.tolist()) for i, _, v in rows], "id long, vec array<double>")
    for threshold in (None, 0.9):
        got = found(r.asDict() | {"rgroup": ""} for r in dense_topk(df, df, 11, threshold, exclude_self=True).collect())
        same(got, brute(rows, rows, 11, True, threshold))


def shuffled_rows(df):
    """Rows that the plan's exchanges wrote, by a run of it."""
    df.collect()
    stack, n = [df._jdf.queryExecution().executedPlan()], 0
    while stack:
        p = stack.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            stack.append(p.executedPlan())
        elif p.nodeName().endswith("QueryStage"):
            stack.append(p.plan())
        if p.nodeName() == "Exchange":
            n += p.metrics().apply("shuffleRecordsWritten").value()
        stack += [p.children().apply(i) for i in range(p.children().size())]
    return n


def test_many_rows_are_few_blocks(spark, monkeypatch):
    """Blocks are as large as a task can hold: 18,000 rows are not routed to cells, and copied as often as tasks need."""
    def routed(*_):
        raise AssertionError("routed")

    monkeypatch.setattr(topk, "_scored", routed)
    n = 18_000
    df = spark.createDataFrame(((i, [float(i % 97), 1.0 + i % 89]) for i in range(n)), "id long, vec array<float>")
    grid = 2 * (math.isqrt(2 * spark.sparkContext.defaultParallelism) + 1)
    top = dense_topk(df, df, 1, exclude_self=True)
    assert top.count() == n
    assert shuffled_rows(top) <= (2 * grid + 1) * n


def test_block_pairs_are_as_large_as_a_task_can_hold(spark):
    """The partial rows of a pass over pairs do not grow with the number of rows (before: one for each 2048)."""
    def largest(n):
        df = spark.createDataFrame(((i, [1.0, float(i)]) for i in range(n)), "id long, vec array<float>")
        out = dense_block_apply(df, df, lambda L, R, S: pd.DataFrame({"id": L["id"], "s": 0.0 if S is None else S.sum(axis=1)}), "id long, s double")
        return out.groupBy("id").count().agg({"count": "max"}).first()[0]

    grid = math.isqrt(2 * spark.sparkContext.defaultParallelism) + 1
    assert largest(3000) <= grid and largest(1024 * grid + 5000) <= grid


def test_one_group_joins_without_a_nested_loop(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "id long, vec array<float>")
    assert "NestedLoop" not in dense_topk(df, df, 3)._jdf.queryExecution().executedPlan().toString()


def test_few_sparse_queries_leave_the_searched_rows_in_place(spark, monkeypatch):
    rows = sparse_rows(4, 260)
    df = spark.createDataFrame(rows, "id long, g string, terms array<long>, weights array<double>")
    left = df.filter("id < 9")
    sent = sparse_topk(left, df, 4)
    moved = shuffled_rows(sent)
    assert moved <= 9 * 4 * df.rdd.getNumPartitions()
    monkeypatch.setattr(topk, "SENT_NONZEROS", 0)
    for limit in (0, 8):
        monkeypatch.setattr(topk, "DIRECT", limit)
        other = found(r.asDict() for r in sparse_topk(left, df, 4).collect())
        same(found(r.asDict() for r in sent.collect()), other)
    assert sparse_topk(df.limit(0), df, 4).count() == 0 and sparse_topk(left, df.limit(0), 4).count() == 0
