"""Recall at ground truth by refinement against whole sorted rows."""

import numpy as np
import pytest

from colweave.operators.evaluate import recall_at_ground_truth


def brute(rows):
    x = np.array([v for _, v, _ in rows], "float64")
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(x @ x.T, 12)
    hit = total = 0
    for i, (rid, _, label) in enumerate(rows):
        k = sum(r[2] == label for r in rows) - 1
        near = sorted((-s[i, j], r[0], r[2]) for j, r in enumerate(rows) if j != i)[:k]
        hit, total = hit + sum(n[2] == label for n in near), total + k
    return hit / total if total else 0.0


@pytest.mark.parametrize("bins,most", [(256, 1024), (4, 5), (2, 1)])
def test_refined_places_match_sorted_rows(spark, bins, most):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(60, 3)), 1)  # many ties
    rows = [(7 * i - 90, x[i].tolist(), int(i % 5) if i < 50 else 100 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label long")
    assert recall_at_ground_truth(df, bins, most).first()[0] == pytest.approx(brute(rows), abs=1e-12)


def test_equal_vectors_are_told_apart_by_id(spark):
    rows = [(1000 * i, [0.5, 0.5], i % 3) for i in range(45)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label long")
    assert recall_at_ground_truth(df, 4, 2).first()[0] == pytest.approx(brute(rows), abs=1e-12)


def test_nothing_to_find(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)], i) for i in range(4)], "id long, vec array<double>, label long")
    assert recall_at_ground_truth(df).first()[0] == 0.0
    assert recall_at_ground_truth(df.limit(0)).first()[0] == 0.0


def test_first_pass_counts_every_other_at_once(monkeypatch):
    """Before, the first pass listed every pair; its counts must be those of the pairs taken one by one, ids that come twice and missing labels too."""
    import pandas as pd

    from colweave.operators import evaluate as ev

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=(700, 3))
    x[:9] = y[:9]
    S = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    left = pd.DataFrame({"id": np.arange(40), "label": rng.integers(0, 4, 40), "lo": -ev.SCALE - 1000, "hi": ev.SCALE + 1000, "id_lo": 0, "id_hi": 1000})
    right = pd.DataFrame({"id": np.arange(700) % 500, "label": rng.integers(0, 4, 700).astype(float)})
    right.loc[3:30, "label"] = np.nan
    monkeypatch.setattr(ev, "CHUNK_CELLS", 5000)
    with monkeypatch.context() as m:
        m.setattr(ev, "_places", None)  # listed no more
        got = ev._parts_kernel(256)(left, right, S)
    # one row leaves an id out, so pairs are listed
    want = ev._parts_kernel(256)(left.assign(id_lo=np.where(left.index == 1, 1, 0)), right, S)
    same = got["id"] != 1
    assert got[same].reset_index(drop=True).equals(want[want["id"] != 1].reset_index(drop=True))
    others = (left["id"].to_numpy()[:, None] != right["id"].to_numpy()).sum()
    assert got["cnt"].sum() == others and got["pos"].sum() == ((left["label"].to_numpy()[:, None] == right["label"].to_numpy()) & (left["id"].to_numpy()[:, None] != right["id"].to_numpy())).sum()
