"""Re-ranking: 1:1 assignment, rescaling of the rest, greedy 1:1 (RNK-1..3, JOIN-9, SET-4).

For the assignment each (source table, target table) pair is one group of
``applyInPandas``: the group holds the top-k candidates of that table pair only
(bounded by source width x k), and different pairs run in parallel. The greedy
1:1 selection is joins and aggregates alone, whatever the size of a pair.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

OUT_SCHEMA = "src_table string, src_col string, src_pos int, tgt_table string, tgt_col string, tgt_pos int, score double, assigned boolean"


def hungarian_max(weights: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-weight assignment of a rectangular matrix; min(rows, cols) pairs.

    Shortest augmenting paths with potentials, one row of the smaller side at a
    time; each step works on a whole row of the matrix.
    """
    w = np.asarray(weights, dtype="float64")
    if not w.size:
        return []
    flip = w.shape[0] > w.shape[1]
    cost = -(w.T if flip else w)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, dtype="int64"), np.zeros(m + 1, dtype="int64")
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[at] = True
            row = row_of[at]
            reduced = cost[row - 1] - u[row] - v[1:]
            closer = ~used[1:] & (reduced < least[1:])
            least[1:][closer], way[1:][closer] = reduced[closer], at
            nxt = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[nxt]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            at = nxt
            if not row_of[at]:
                break
        while at:
            row_of[at], at = row_of[way[at]], way[at]
    pairs = [(int(r) - 1, j) for j, r in enumerate(row_of[1:]) if r]
    return sorted((j, i) if flip else (i, j) for i, j in pairs)


def _arrange(pdf: pd.DataFrame) -> pd.DataFrame:
    """Assignment over the group's candidates; leftovers rescaled below the weakest assignment."""
    src = pdf[["src_col", "src_pos"]].drop_duplicates().sort_values(["src_pos", "src_col"])
    tgt = pdf[["tgt_col", "tgt_pos"]].drop_duplicates().sort_values(["tgt_pos", "tgt_col"])
    si = {c: i for i, c in enumerate(src["src_col"])}
    ti = {c: i for i, c in enumerate(tgt["tgt_col"])}
    M = np.zeros((len(si), len(ti)))
    for s, t, sc in zip(pdf["src_col"], pdf["tgt_col"], pdf["score"]):
        M[si[s], ti[t]] = sc
    pairs = hungarian_max(M)
    st, tt = pdf["src_table"].iloc[0], pdf["tgt_table"].iloc[0]
    spos = dict(zip(src["src_col"], src["src_pos"]))
    tpos = dict(zip(tgt["tgt_col"], tgt["tgt_pos"]))
    scol, tcol = list(src["src_col"]), list(tgt["tgt_col"])
    assigned = {(scol[i], tcol[j]): float(M[i, j]) for i, j in pairs}
    rows = [(st, s, int(spos[s]), tt, t, int(tpos[t]), sc, True) for (s, t), sc in assigned.items()]
    rest = pdf[[(s, t) not in assigned for s, t in zip(pdf["src_col"], pdf["tgt_col"])]]
    if len(rest) and assigned:
        lo = min(assigned.values())
        hi = float(rest["score"].max())
        factor = (lo - 0.01) / hi if hi > 0 else 1.0
        for s, sp, t, tp, sc in zip(rest["src_col"], rest["src_pos"], rest["tgt_col"], rest["tgt_pos"], rest["score"]):
            rows.append((st, s, int(sp), tt, t, int(tp), float(sc) * factor, False))
    return pd.DataFrame(rows, columns=["src_table", "src_col", "src_pos", "tgt_table", "tgt_col", "tgt_pos", "score", "assigned"])


def bipartite_rerank(topk: DataFrame) -> DataFrame:
    """Assigned pairs keep their score (0 for an assigned absent pair); the rest scale under them."""
    cols = ["src_table", "src_col", "src_pos", "tgt_table", "tgt_col", "tgt_pos", "score"]
    return topk.select(*cols).groupBy("src_table", "tgt_table").applyInPandas(_arrange, OUT_SCHEMA)


def greedy_one_to_one(matches: DataFrame) -> DataFrame:
    """Greedy 1:1 by score desc within each table pair (RNK-3).

    Ties go to the smaller source position, then target position. Taking the
    best remaining pair again and again is the same as taking, round by round,
    all pairs that are the best left for both their columns: a round is two
    aggregates and a few equi-joins, and no table pair has to fit a task.
    """
    cols = ["src_table", "src_col", "src_pos", "tgt_table", "tgt_col", "tgt_pos", "score"]
    src, tgt = ["src_table", "tgt_table", "src_col"], ["src_table", "tgt_table", "tgt_col"]
    rank = F.struct((-F.col("score")).alias("s"), "src_pos", "tgt_pos", "src_col", "tgt_col")
    left = cut_lineage(matches.select(*cols).dropDuplicates([*src, "tgt_col"]).withColumn("_rank", rank))
    taken = []
    while not left.isEmpty():
        best_src = left.groupBy(*src).agg(F.min("_rank").alias("_a"))
        best_tgt = left.groupBy(*tgt).agg(F.min("_rank").alias("_b"))
        won = cut_lineage(left.join(best_src, src).join(best_tgt, tgt).filter("_rank = _a AND _rank = _b").select(*cols))
        taken.append(won)
        left = cut_lineage(left.join(won.select(*src), src, "left_anti").join(won.select(*tgt), tgt, "left_anti"))
    return reduce(DataFrame.unionByName, taken) if taken else left.select(*cols)
