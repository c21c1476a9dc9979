"""Parameter sweeps and result pivots (AGG-22, AGG-23, AGG-24).

A sweep is one plan: every configuration is a row, carried as a grouping key
through the same joins, so all configurations share one scan of the inputs.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_sweep(preds: DataFrame, gts: dict[str, DataFrame], ks: list[int]) -> DataFrame:
    """``(benchmark, model_label, value)``: share of ground-truth pairs ranked within k, per (benchmark, k)."""
    out = None
    for bench, gt in gts.items():
        g = gt.select("source", "target").distinct().withColumn("benchmark", F.lit(bench))
        j = g.join(preds.select("source", "target", "rank"), ["source", "target"], "left")
        j = j.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
        r = j.groupBy("benchmark", "k").agg(
            F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)).alias("value")
        ).select("benchmark", F.concat(F.lit("top"), F.col("k").cast("string")).alias("model_label"), "value")
        out = r if out is None else out.unionByName(r)
    return out


def pivot_metrics(long: DataFrame, labels: list[str]) -> DataFrame:
    """Benchmark x model pivot with explicit labels (no extra job to discover them)."""
    return long.groupBy("benchmark").pivot("model_label", labels).agg(F.first("value"))


def input_stats(profile: DataFrame, matches: DataFrame, src: str, tgt: str) -> DataFrame:
    """ncols / nrows of both tables and the number of matches (AGG-24), one aggregation over a union."""
    p = profile.select("table_id", "n_rows", F.lit(0).alias("_m"))
    m = matches.select(F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("long").alias("n_rows"), F.lit(1).alias("_m"))
    u = p.unionByName(m)
    is_s, is_t = F.col("table_id") == src, F.col("table_id") == tgt
    return u.agg(
        F.count(F.when(is_s, 1)).alias("ncols_src"), F.count(F.when(is_t, 1)).alias("ncols_tgt"),
        F.max(F.when(is_s, F.col("n_rows"))).alias("nrows_src"), F.max(F.when(is_t, F.col("n_rows"))).alias("nrows_tgt"),
        F.sum("_m").alias("nmatches"),
    )


#: Orders of the three candidate strategies; -1 leaves a strategy out. All 15 arrangements of one to three strategies.
STRATEGY_ORDERS = [
    dict(zip(("strsim", "embedding", "equal"), (place.index(n) if n in place else -1 for n in ("strsim", "embedding", "equal"))))
    for size in (1, 2, 3) for place in permutations(("strsim", "embedding", "equal"), size)
]


def strategy_orders(cands: DataFrame, orders: list[dict], k: int) -> DataFrame:
    """Merged top-k candidates under every strategy order, as one plan.

    ``cands`` holds all strategies' candidates once; a configuration is a key that
    each row is copied to, so no strategy is computed again. Returns
    ``(config, src_table, src_col, tgt_table, tgt_col, score, strategy, rank)``.
    """
    prios = F.create_map(*[
        x for name in ("strsim", "embedding", "equal")
        for x in (F.lit(name), F.array(*[F.lit(int(o.get(name, -1))) for o in orders]))])
    each = cands.select("*", F.posexplode(prios[F.col("strategy")]).alias("config", "_prio")).filter(F.col("_prio") >= 0)
    keys = ["config", "src_table", "src_col", "src_pos", "tgt_table", "tgt_col", "tgt_pos"]
    merged = each.groupBy(*keys).agg(F.max_by("score", "_prio").alias("score"), F.max_by("strategy", "_prio").alias("strategy"))
    w = Window.partitionBy("config", "src_table", "src_col", "tgt_table").orderBy(F.col("score").desc(), F.col("tgt_pos").asc())
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "config", "src_table", "src_col", "tgt_table", "tgt_col", "score", "strategy", "rank")
