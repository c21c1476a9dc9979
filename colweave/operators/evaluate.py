"""Evaluation against ground truth (AGG-10..19, SET-2/3/6, JOIN-8, WIN-1/2).

``preds``: ``(source, target, score, rank)`` with ranks 1..n per source.
``gt``: ``(source, target)``. All metrics are joins plus global aggregates;
nothing is collected to the driver except the one-row results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import global_index
from .similarity import dense_block_apply, dense_topk


def ranking_metrics(preds: DataFrame, gt: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """n_ground_truth, coverage, mrr, mean_rank (found only), top{k}_correct / _accuracy (AGG-10)."""
    covered = preds.select("source").distinct().withColumn("_cov", F.lit(1))
    j = gt.join(covered, "source", "left").join(preds.select("source", "target", "rank"), ["source", "target"], "left")
    n = F.count(F.lit(1))
    aggs = [
        n.alias("n_ground_truth"),
        F.coalesce(F.try_divide(F.sum(F.coalesce("_cov", F.lit(0))), n), F.lit(0.0)).cast("double").alias("coverage"),
        F.coalesce(F.try_divide(F.sum(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), n), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg("rank"), F.lit(0.0)).cast("double").alias("mean_rank"),
    ]
    for k in sorted(set(ks)):
        hit = F.sum(F.when(F.col("rank") <= k, 1).otherwise(0))
        aggs.append(hit.cast("long").alias(f"top{k}_correct"))
        aggs.append(F.coalesce(F.try_divide(hit, n), F.lit(0.0)).cast("double").alias(f"top{k}_accuracy"))
    return j.agg(*aggs)


def ranking_errors(preds: DataFrame, gt: DataFrame) -> DataFrame:
    """Per ground-truth row: top-1/3/5 predictions, rank of the truth and flags."""
    lists = preds.filter(F.col("rank") <= 5).groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("target").cast("string").alias("t")))).alias("_l")
    )
    top = lambda k: F.array_join(F.transform(F.filter("_l", lambda s: s["rank"] <= k), lambda s: s["t"]), ",")
    j = gt.join(lists, "source", "left").join(preds.select("source", "target", "rank"), ["source", "target"], "left")
    return j.select(
        F.col("source").alias("source_column"),
        F.col("target").alias("ground_truth_target"),
        F.element_at(F.col("_l"), 1)["t"].alias("predicted_top1"),
        F.coalesce(top(3), F.lit("")).alias("predicted_top3"),
        F.coalesce(top(5), F.lit("")).alias("predicted_top5"),
        F.col("rank").alias("ground_truth_rank"),
        F.coalesce(F.col("rank") == 1, F.lit(False)).alias("is_top1_correct"),
        F.coalesce(F.col("rank") <= 3, F.lit(False)).alias("is_top3_correct"),
        F.col("rank").isNotNull().alias("is_found"),
    )


def pairset_metrics(pred_pairs: DataFrame, gt_pairs: DataFrame) -> DataFrame:
    """predicted, ground_truth, correct, false_positives/negatives, precision, recall, f1 (AGG-11)."""
    p = pred_pairs.select("source", "target").distinct().withColumn("_p", F.lit(1))
    g = gt_pairs.select("source", "target").distinct().withColumn("_g", F.lit(1))
    j = p.join(g, ["source", "target"], "full_outer")
    a = j.agg(
        F.sum(F.coalesce("_p", F.lit(0))).cast("long").alias("predicted"),
        F.sum(F.coalesce("_g", F.lit(0))).cast("long").alias("ground_truth"),
        F.sum(F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), 1).otherwise(0)).cast("long").alias("correct"),
    )
    prec = F.coalesce(F.try_divide(F.col("correct"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("correct"), F.col("ground_truth")), F.lit(0.0))
    return a.select(
        "predicted", "ground_truth", "correct",
        (F.col("predicted") - F.col("correct")).alias("false_positives"),
        (F.col("ground_truth") - F.col("correct")).alias("false_negatives"),
        prec.cast("double").alias("precision"), rec.cast("double").alias("recall"),
        F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).cast("double").alias("f1"),
    )


def pairset_errors(pred_pairs: DataFrame, gt_pairs: DataFrame) -> DataFrame:
    """False positives and false negatives as rows (SET-2)."""
    p = pred_pairs.select("source", "target").distinct()
    g = gt_pairs.select("source", "target").distinct()
    fp = p.join(g, ["source", "target"], "left_anti").withColumn("error_type", F.lit("false_positive"))
    fn = g.join(p, ["source", "target"], "left_anti").withColumn("error_type", F.lit("false_negative"))
    return fp.unionByName(fn).select(F.col("source").alias("source_column"), F.col("target").alias("target_column"), "error_type")


def mrr(preds: DataFrame, gt: DataFrame) -> DataFrame:
    """Mean over ground-truth pairs of 1/rank, 0 when missing (AGG-12)."""
    j = gt.join(preds.select("source", "target", "rank"), ["source", "target"], "left")
    return j.agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def mrr_adjusted(preds: DataFrame, gt: DataFrame) -> DataFrame:
    """Per predicted source with ground truth: 1 / rank of the first correct target (AGG-13)."""
    srcs = preds.select("source").distinct().join(gt.select("source").distinct(), "source", "left_semi")
    best = preds.join(gt, ["source", "target"], "left_semi").groupBy("source").agg(F.min("rank").alias("best"))
    j = srcs.join(best, "source", "left")
    return j.agg(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr_adjusted"))


def _unordered(df: DataFrame) -> DataFrame:
    a, b = F.col("source").cast("string"), F.col("target").cast("string")
    return df.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"))


def recall_pairs(preds: DataFrame, gt: DataFrame) -> DataFrame:
    """Unordered pairs; each ground-truth pair counted once; denominator = ground-truth rows (AGG-14)."""
    g = _unordered(gt).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_c"))
    p = _unordered(preds).distinct().withColumn("_hit", F.lit(1))
    j = g.join(p, ["_a", "_b"], "left")
    return j.agg(
        F.coalesce(F.try_divide(F.count("_hit"), F.sum("_c")), F.lit(0.0)).cast("double").alias("recall")
    )


def recall_at_topk(preds: DataFrame, gt: DataFrame, k: int) -> DataFrame:
    """Share of distinct ground-truth pairs among each source's top k, rounded to 3 (AGG-15)."""
    g = gt.select("source", "target").distinct()
    top = preds.filter(F.col("rank") <= k).select("source", "target").distinct().withColumn("_hit", F.lit(1))
    j = g.join(top, ["source", "target"], "left")
    return j.agg(F.round(F.try_divide(F.count("_hit"), F.count(F.lit(1))), 3).alias("recall")).select(
        F.lit(k).alias("k"), "recall"
    )


def metrics_core(preds: DataFrame, gt: DataFrame, scope: str = "all") -> DataFrame:
    """Precision, recall, F1, precision in the top 10 percent and recall at |GT| (AGG-16).

    Pinned definitions: the global order is score desc, then source, target;
    top 10 percent = the first ceil(0.1 n) matches; recall at |GT| = hits in the
    first |GT| matches / |GT|. ``n`` and ``|GT|`` are two scalars from counts;
    places in the order come from ranges of it (``global_index``), which also
    stores the predictions, so they are computed once.
    """
    g = gt.select("source", "target").distinct()
    order = [F.col("score").desc(), F.col("source").asc(), F.col("target").asc()]
    p = global_index(preds.select("source", "target", "score").distinct(), order, "_place")
    n_pred = p.count()
    n_gt = g.count()
    m10 = math.ceil(0.1 * n_pred)
    j = p.join(g.withColumn("_hit", F.lit(1)), ["source", "target"], "left")
    hit = F.col("_hit").isNotNull()
    a = j.agg(
        F.count(F.when(hit, 1)).alias("h_all"),
        F.count(F.when(hit & (F.col("_place") < m10), 1)).alias("h_10"),
        F.count(F.when(hit & (F.col("_place") < n_gt), 1)).alias("h_g"),
    )
    prec = F.lit(0.0) if n_pred == 0 else F.col("h_all") / F.lit(float(n_pred))
    rec = F.lit(0.0) if n_gt == 0 else F.col("h_all") / F.lit(float(n_gt))
    return a.select(
        F.lit(scope).alias("scope"),
        prec.alias("precision"),
        rec.alias("recall"),
        F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"),
        (F.lit(0.0) if m10 == 0 else F.col("h_10") / F.lit(float(m10))).alias("precision_top10pct"),
        (F.lit(0.0) if n_gt == 0 else F.col("h_g") / F.lit(float(n_gt))).alias("recall_at_gt"),
    )


# ---- embedding-space label metrics (self join, self excluded) ----

def label_topk_accuracy(vecs: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Share of items with at least one same-label item among their k nearest others (AGG-17)."""
    kmax = max(ks)
    top = dense_topk(vecs.select("id", "vec"), vecs.select("id", "vec"), kmax, exclude_self=True)
    lab = vecs.select("id", "label")
    t = top.join(lab.withColumnRenamed("id", "lid").withColumnRenamed("label", "l_label"), "lid").join(
        lab.withColumnRenamed("id", "rid").withColumnRenamed("label", "r_label"), "rid"
    )
    per = t.groupBy("lid").agg(
        *[F.max(F.when((F.col("rank") <= k) & (F.col("l_label") == F.col("r_label")), 1).otherwise(0)).alias(f"h{k}") for k in ks]
    )
    allids = vecs.select(F.col("id").alias("lid"))
    per = allids.join(per, "lid", "left")
    # one aggregate, then one row for each k
    means = per.agg(*[F.avg(F.coalesce(F.col(f"h{k}"), F.lit(0))).alias(f"h{k}") for k in ks])
    return means.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("accuracy")) for k in ks])))


#: Similarities that a step looks at together: they stay in a core's cache.
CHUNK_CELLS = 1 << 17


def _chunks(S) -> Iterator[slice]:
    """Rows of a matrix, some at a time."""
    step = max(1, CHUNK_CELLS // max(1, S.shape[1]))
    return (slice(i, min(i + step, S.shape[0])) for i in range(0, S.shape[0], step))


def _best_same_label(L, R, S):
    if S is None:
        return pd.DataFrame({"id": pd.Series([], dtype="int64"), "best": pd.Series([], dtype="float64")})
    same = (L["label"].to_numpy()[:, None] == R["label"].to_numpy()[None, :]) & (L["id"].to_numpy()[:, None] != R["id"].to_numpy()[None, :])
    M = np.where(same, S, -np.inf)
    return pd.DataFrame({"id": L["id"].to_numpy(), "best": M.max(axis=1)})


def _count_above(L, R, S):
    if S is None:
        return pd.DataFrame({"id": pd.Series([], dtype="int64"), "above": pd.Series([], dtype="int64")})
    other = L["id"].to_numpy()[:, None] != R["id"].to_numpy()[None, :]
    above = ((S > L["aux"].to_numpy()[:, None]) & other).sum(axis=1)
    return pd.DataFrame({"id": L["id"].to_numpy(), "above": above.astype("int64")})


def embedding_mrr(vecs: DataFrame) -> DataFrame:
    """Mean reciprocal rank of the best same-label neighbour (AGG-19 MRR).

    rank = 1 + number of other items strictly more similar than the best
    same-label item; with no same-label item the masked self (-1) is the best.
    Two block passes: the best same-label similarity, then the count above it.
    """
    v = vecs.select("id", "vec", "label")
    best = dense_block_apply(v, v, _best_same_label, "id long, best double").groupBy("id").agg(F.max("best").alias("best"))
    best = best.withColumn("best", F.when(F.col("best") == float("-inf"), F.lit(-1.0)).otherwise(F.col("best")))
    best = cut_lineage(best)  # the second pass sizes its blocks from it and reads it: one number for each item
    left = v.join(best, "id").withColumnRenamed("best", "aux")
    cnt = dense_block_apply(left, v, _count_above, "id long, above long").groupBy("id").agg(F.sum("above").alias("above"))
    return cnt.agg(F.avg(1.0 / (F.col("above") + 1)).alias("mrr"))


def _exp_sums(t):
    def k(L, R, S):
        if S is None:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "s_all": pd.Series([], dtype="float64"), "s_pos": pd.Series([], dtype="float64")})
        other = L["id"].to_numpy()[:, None] != R["id"].to_numpy()[None, :]
        same = L["label"].to_numpy()[:, None] == R["label"].to_numpy()[None, :]
        E = np.exp(S / t) * other
        return pd.DataFrame({"id": L["id"].to_numpy(), "s_all": E.sum(axis=1), "s_pos": (E * same).sum(axis=1)})

    return k


def contrastive_loss(vecs: DataFrame, temperature: float = 0.5) -> DataFrame:
    """Mean of -ln(sum over same-label others exp(s/T) / sum over others exp(s/T)) (AGG-20)."""
    v = vecs.select("id", "vec", "label")
    sums = dense_block_apply(v, v, _exp_sums(temperature), "id long, s_all double, s_pos double").groupBy("id").agg(
        F.sum("s_all").alias("s_all"), F.sum("s_pos").alias("s_pos")
    )
    return sums.agg(F.avg(-F.log(F.col("s_pos") / F.col("s_all"))).alias("loss"))


# ---- recall at ground truth: exact selection by refinement ----

#: Similarities are compared as whole numbers, best first: minus this many times the similarity.
SCALE = 10 ** 12
STATE = ("lo", "hi", "id_lo", "id_hi")


def _places(L, R, S):
    """The others within each left row's interval: (left row, right row, place in the order of similarity)."""
    lid, rid = L["id"].to_numpy(), R["id"].to_numpy()
    lo, hi, id_lo, id_hi = (L[c].to_numpy() for c in STATE)
    # by similarities first, a little wider than the interval: most of a narrow one's others are left out here
    at = np.flatnonzero(((S <= ((1 - lo) / SCALE)[:, None]) & (S >= ((-1 - hi) / SCALE)[:, None])).ravel())
    row, col = np.divmod(at.astype("int32"), np.int32(S.shape[1]))
    place = -np.rint(S.ravel()[at] * SCALE).astype("int64")
    other = rid[col]
    within = (other != lid[row]) & (place >= lo[row]) & (place <= hi[row])
    if len(rid) and ((id_lo > rid.min()) | (id_hi < rid.max())).any():
        within &= (other >= id_lo[row]) & (other <= id_hi[row])
    if within.all():
        return row, col, place
    return row[within], col[within], place[within]


def _width(lo, hi, bins: int):
    """Width of the parts of an interval; it is divided before it is subtracted, so that no number overflows."""
    return hi // bins - lo // bins + 1


def _same_ids(lid, rid):
    """All (left row, right row) with one id."""
    order = np.argsort(rid, kind="stable")
    ids = rid[order]
    first = np.searchsorted(ids, lid)
    n = np.searchsorted(ids, lid, "right") - first
    row = np.repeat(np.arange(len(lid)), n)
    return row, order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(row))]


def _counts_of_all(L, R, S, low: int, width: int, slots: int):
    """Counts of the others of each left row by part, and of those with its label, where one interval holds every other of every row."""
    first = low // width
    # labels as small numbers: comparing them is cheaper; a missing one equals none
    label = np.concatenate([L["label"].to_numpy(), R["label"].to_numpy()])
    code = np.unique(label, return_inverse=True)[1].astype("int32")
    ll, rl = code[: len(L)].copy(), code[len(L) :].copy()
    ll[pd.isna(L["label"]).to_numpy()], rl[pd.isna(R["label"]).to_numpy()] = -1, -2

    def part(s):
        t = s * -SCALE
        np.rint(t, out=t)
        t /= width
        np.floor(t, out=t)
        t -= first
        return t.astype("intp")

    found = np.empty((len(L), 2, slots), "int64")  # other label, same label
    for c in _chunks(S):
        at = part(S[c])
        n = len(at)
        at += (np.arange(n) * (2 * slots))[:, None]
        at += np.multiply(ll[c, None] == rl, slots, dtype="int32")
        found[c] = np.bincount(at.ravel(), minlength=n * 2 * slots).reshape(n, 2, slots)
    row, col = _same_ids(L["id"].to_numpy(), R["id"].to_numpy())
    np.subtract.at(found, (row, (ll[row] == rl[col]).astype("intp"), part(S[row, col])), 1)
    return found.sum(axis=1).ravel(), found[:, 1].ravel()


def _parts_kernel(bins: int):
    """Per left row and part of its interval: how many others fall into it and how many of them have its label."""
    def k(L, R, S):
        if S is None:
            return pd.DataFrame({c: np.zeros(0, "int64") for c in ("id", "start", "cnt", "pos")})
        lo, hi, id_lo, id_hi = (L[c].to_numpy() for c in STATE)
        rid = R["id"].to_numpy()
        one = lo[0] < hi[0] and (lo == lo[0]).all() and (hi == hi[0]).all() and (id_lo <= rid.min()).all() and (id_hi >= rid.max()).all()
        if one and S.max() <= (-1 - lo[0]) / SCALE and S.min() >= (1 - hi[0]) / SCALE:
            # the first pass: every other counts
            width = np.full(len(L), _width(int(lo[0]), int(hi[0]), bins))
            first = lo // width
            cnt, pos = _counts_of_all(L, R, S, int(lo[0]), int(width[0]), bins + 2)
            return table(L, cnt, pos, first, width)
        row, col, place = _places(L, R, S)
        tied = lo == hi  # one similarity is left: the ids decide
        low = np.where(tied, id_lo, lo)
        width = _width(low, np.where(tied, id_hi, hi), bins)
        first = low // width  # an interval meets at most bins + 1 parts
        value = np.where(tied[row], R["id"].to_numpy()[col], place) if tied.any() else place
        # places are below 2^53, so the quotient rounded down is that of whole numbers
        part = value // width[row] if tied.any() else np.floor(value / width[row]).astype("int64")
        at = row * (bins + 2) + part - first[row]
        same = R["label"].to_numpy()[col] == L["label"].to_numpy()[row]
        n = len(L) * (bins + 2)
        return table(L, np.bincount(at, minlength=n), np.bincount(at[same], minlength=n), first, width)

    def table(L, cnt, pos, first, width):
        met = np.flatnonzero(cnt)
        of = met // (bins + 2)
        return pd.DataFrame({"id": L["id"].to_numpy()[of], "start": (first[of] + met % (bins + 2)) * width[of], "cnt": cnt[met], "pos": pos[met]})

    return k


def _listing(L, R, S):
    """Every other row in the interval of each left row."""
    if S is None:
        return pd.DataFrame({c: np.zeros(0, "int64") for c in ("id", "place", "rid", "is_pos")})
    row, col, place = _places(L, R, S)
    same = R["label"].to_numpy()[col] == L["label"].to_numpy()[row]
    return pd.DataFrame({"id": L["id"].to_numpy()[row], "place": place, "rid": R["id"].to_numpy()[col], "is_pos": same.astype("int64")})


def recall_at_ground_truth(vecs: DataFrame, bins: int = 256, most: int = 1024) -> DataFrame:
    """Same-label items among each item's (class size - 1) nearest others, summed over sum of (class size - 1) (AGG-18).

    Singleton classes are skipped. Where the (class size - 1)-th place of a row lies is found by
    refinement: a pass counts the others in ``bins`` parts of the row's interval of similarities
    (at most ``bins`` + 1 rows for each item), the part with that place becomes the interval, and so on until it
    holds at most ``most`` items; where these all have one similarity, the
    interval goes on over ids, which close ties. Only the rows that are left open take part in the next
    pass. The last intervals are listed and ranked (similarity rounded to 12 decimals, then id).
    """
    shift = bins.bit_length() - 1
    if bins != 1 << shift or bins < 2:
        raise ValueError("the number of parts must be a power of two")
    v = vecs.select("id", "vec", "label")
    sizes = v.groupBy("label").agg(F.count(F.lit(1)).alias("csize"))
    ids = v.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    whole = {"lo": -SCALE - 1000, "hi": SCALE + 1000, "id_lo": ids["lo"] or 0, "id_hi": ids["hi"] or 0}
    opened = cut_lineage(
        v.join(sizes, "label").filter("csize > 1")
        .select("id", "vec", "label", (F.col("csize") - 1).alias("k"), (F.col("csize") - 1).alias("left"), F.lit(0).cast("long").alias("pos"),
                *[F.lit(x).cast("long").alias(c) for c, x in whole.items()]))
    closed = None
    w = Window.partitionBy("id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        parts = dense_block_apply(opened, v, _parts_kernel(bins), "id long, start long, cnt long, pos long", extra=STATE)
        parts = parts.groupBy("id", "start").agg(F.sum("cnt").alias("cnt"), F.sum("pos").alias("part_pos"))
        run = parts.select("id", "start", "cnt", F.sum("cnt").over(w).alias("cum"), (F.sum("part_pos").over(w) - F.col("part_pos")).alias("before"))
        found = run.join(opened, "id").filter((F.col("cum") >= F.col("left")) & (F.col("cum") - F.col("cnt") < F.col("left")))
        tied = F.col("lo") == F.col("hi")

        def width(lo: str, hi: str):
            return F.shiftright(hi, shift) - F.shiftright(lo, shift) + 1

        def narrowed(lo: str, hi: str, here):
            end = F.col("start") + width(lo, hi) - 1
            return [F.when(here, F.greatest(F.col(lo), F.col("start"))).otherwise(F.col(lo)).alias(lo), F.when(here, F.least(F.col(hi), end)).otherwise(F.col(hi)).alias(hi)]

        state = cut_lineage(found.select(
            "id", "vec", "label", "k", (F.col("left") - (F.col("cum") - F.col("cnt"))).alias("left"), (F.col("pos") + F.col("before")).alias("pos"),
            *narrowed("lo", "hi", ~tied), *narrowed("id_lo", "id_hi", tied), "cnt"))
        done = state.filter(F.col("cnt") <= most).drop("cnt")
        closed = done if closed is None else closed.unionByName(done)
        opened = state.filter(F.col("cnt") > most).drop("cnt")
        if opened.isEmpty():
            break
    listed = dense_block_apply(closed, v, _listing, "id long, place long, rid long, is_pos long", extra=STATE)
    order = Window.partitionBy("id").orderBy("place", "rid")
    taken = listed.withColumn("_r", F.row_number().over(order)).join(closed.select("id", "left"), "id").filter(F.col("_r") <= F.col("left"))
    per = closed.select("id", "k", "pos").join(taken.groupBy("id").agg(F.sum("is_pos").alias("pos_in")), "id", "left")
    return per.agg(
        F.coalesce(F.try_divide(F.sum(F.col("pos") + F.coalesce("pos_in", F.lit(0))), F.sum("k")), F.lit(0.0)).alias("recall_at_gt")
    )
