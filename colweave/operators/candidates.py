"""Candidate generation and merging (JOIN-1, JOIN-2, SET-1, TOP-1, FLT-1/2, FN-12).

Candidate rows: ``(src_table, src_col, src_pos, tgt_table, tgt_col, tgt_pos, strategy, score)``.
``pairs`` is the relation of table pairs to compare ``(src_table, tgt_table)``.

Name similarity forms only pairs that can reach the thresholds. Names are multisets of characters
ordered by rarity; a pair with enough characters in common shares one among the first few of
either (prefix filter), so an equi-join on (table pair, character) finds it. Length
and character bounds follow, and scoring runs on what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import alnum_lower, equal_name_key
from ..functions.strsim import alignment_score, fuzzy_ratio, ratio_upper_bound
from .profile import common_prefix_expr

CAND_COLS = ["src_table", "src_col", "src_pos", "tgt_table", "tgt_col", "tgt_pos", "strategy", "score"]
DEFAULT_ORDER = {"strsim": 0, "embedding": 1, "equal": 2}


def _side(cols: DataFrame, prefix: str) -> DataFrame:
    return cols.select(
        F.col("table_id").alias(f"{prefix}_table"),
        F.col("col_name").alias(f"{prefix}_col"),
        F.col("col_pos").alias(f"{prefix}_pos"),
    )


def equal_name_candidates(src_cols: DataFrame, tgt_cols: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score 1.0 where strip+lower+punctuation-to-space names are equal (JOIN-2)."""
    s = _side(src_cols, "src").withColumn("_k", equal_name_key(F.col("src_col")))
    t = _side(tgt_cols, "tgt").withColumn("_k", equal_name_key(F.col("tgt_col")))
    j = s.join(pairs, "src_table").join(t, ["tgt_table", "_k"])
    return j.select(*CAND_COLS[:6], F.lit("equal").alias("strategy"), F.lit(1.0).alias("score"))


def _with_prefix_stripped(cols: DataFrame, prefix: str) -> DataFrame:
    """Common prefix of a table's names removed at every occurrence (S7)."""
    pre = cols.groupBy(f"{prefix}_table").agg(F.min(f"{prefix}_col").alias("_lo"), F.max(f"{prefix}_col").alias("_hi"))
    pre = pre.select(f"{prefix}_table", common_prefix_expr(F.col("_lo"), F.col("_hi")).alias("_prefix"))
    return cols.join(pre, f"{prefix}_table").withColumn(
        f"{prefix}_prep",
        F.when(F.col("_prefix") == "", F.col(f"{prefix}_col")).otherwise(F.replace(F.col(f"{prefix}_col"), F.col("_prefix"), F.lit(""))),
    ).drop("_prefix")


def _multiset(text: Column) -> Column:
    """The characters of a text, each with a number that tells how often it came before."""
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    return F.transform(chars, lambda x, i: F.struct(x.alias("ch"), F.size(F.filter(F.slice(chars, 1, i), lambda y: y == x)).alias("nth")))


def _ceil(x: Column) -> Column:
    return F.ceil(x - 1e-9).cast("int")


def prefix_pairs(src: DataFrame, tgt: DataFrame, pairs: DataFrame, text: Callable[[str], Column], least_common: Callable[[Column], Column]) -> DataFrame:
    """Rows of ``src`` and ``tgt`` whose texts may have enough characters in common (exact blocking).

    ``text(side)`` is the text of a side (``src`` or ``tgt``); ``least_common`` of its length is the least number of characters that it
    has in common with any text it pairs with. Of the characters in order of rarity all but that many, and one, are indexed.
    """
    sides = {p: df.withColumn("_text", text(p)).filter(F.length("_text") > 0) for p, df in (("src", src), ("tgt", tgt))}
    tokens = {p: df.withColumn("_t", F.explode(_multiset(F.col("_text")))) for p, df in sides.items()}
    rarity = tokens["src"].select("_t").unionByName(tokens["tgt"].select("_t")).groupBy("_t").agg(F.count("*").alias("_df"))

    def indexed(p: str, df: DataFrame, own: list[str]) -> DataFrame:
        n = F.length("_text")
        ordered = df.join(rarity, "_t").groupBy(*own, "_text").agg(F.sort_array(F.collect_list(F.struct("_df", "_t"))).alias("_all"))
        first = F.slice("_all", 1, F.greatest(n - least_common(n) + 1, F.lit(1)))
        return ordered.withColumn("_e", F.explode(first)).select(*own, F.col("_e._t").alias("_t"))

    s, t = (indexed(p, tokens[p], df.columns) for p, df in (("src", src), ("tgt", tgt)))
    return s.join(pairs, "src_table").join(t, ["tgt_table", "_t"]).drop("_t").distinct()


def _prepared(src_cols: DataFrame, tgt_cols: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _with_prefix_stripped(_side(src_cols, "src"), "src"), _with_prefix_stripped(_side(tgt_cols, "tgt"), "tgt")


def aligned_pairs(src_cols: DataFrame, tgt_cols: DataFrame, pairs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Column pairs with an alignment of at least ``threshold`` and their ``alignment``.

    The shorter name has that share of its letters in the longer one, which is at most twice as long.
    """
    s, t = _prepared(src_cols, tgt_cols)
    p = prefix_pairs(s, t, pairs, lambda side: alnum_lower(F.col(f"{side}_prep")), lambda n: _ceil(threshold * F.ceil(n / 2)))
    return p.withColumn("alignment", alignment_score(F.col("src_prep"), F.col("tgt_prep"))).filter(F.col("alignment") >= threshold)


def fuzzy_pairs(src_cols: DataFrame, tgt_cols: DataFrame, pairs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Column pairs with a ratio of at least ``threshold`` and their ``fuzzy``.

    Twice the common characters over both lengths is at least the threshold, so the lengths are near as well.
    """
    least = threshold - 0.005  # the ratio is compared as a whole percent
    s, t = _prepared(src_cols, tgt_cols)
    p = prefix_pairs(s, t, pairs, lambda side: F.col(f"{side}_prep"), lambda n: _ceil(least / 2 * (n + _ceil(n * least / (2 - least)))))
    p = p.filter(ratio_upper_bound(F.col("src_prep"), F.col("tgt_prep")) >= least)
    return p.withColumn("fuzzy", fuzzy_ratio(F.col("src_prep"), F.col("tgt_prep"))).filter(F.col("fuzzy") >= threshold)


def strsim_candidates(src_cols: DataFrame, tgt_cols: DataFrame, pairs: DataFrame,
                      alignment_threshold: float = 0.95, fuzzy_threshold: float = 0.6) -> DataFrame:
    """Alignment >= 0.95 or fuzzy ratio >= 0.6; the fuzzy score overwrites (JOIN-1, FLT-2)."""
    fuzzy = fuzzy_pairs(src_cols, tgt_cols, pairs, fuzzy_threshold).select(*CAND_COLS[:6], "fuzzy", F.lit(None).cast("double").alias("alignment"))
    aligned = aligned_pairs(src_cols, tgt_cols, pairs, alignment_threshold).select(*CAND_COLS[:6], F.lit(None).cast("double").alias("fuzzy"), "alignment")
    both = fuzzy.unionByName(aligned).groupBy(*CAND_COLS[:6]).agg(F.coalesce(F.max("fuzzy"), F.max("alignment")).alias("score"))
    return both.select(*CAND_COLS[:6], F.lit("strsim").alias("strategy"), "score")


def all_columns(cols: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every target column as a candidate of every source column of its table pair, with score 0 (a judge's work list)."""
    s = _side(cols, "src").join(pairs, "src_table")
    t = _side(cols, "tgt")
    return s.join(t, "tgt_table").select(
        "src_table", "src_col", "tgt_table", "tgt_col", F.lit(0.0).alias("score"), (F.col("tgt_pos") + 1).alias("rank"))


def merge_strategies(cands: list[DataFrame], order: dict | None = None) -> DataFrame:
    """Union of strategy candidates; per pair the last strategy in ``order`` wins (SET-1, S5).

    A strategy with order -1 is skipped.
    """
    order = dict(DEFAULT_ORDER if order is None else order)
    prio = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    u = None
    for c in cands:
        u = c if u is None else u.unionByName(c)
    u = u.withColumn("_prio", prio[F.col("strategy")]).filter(F.col("_prio").isNotNull() & (F.col("_prio") >= 0))
    keys = CAND_COLS[:6]
    return u.groupBy(*keys).agg(
        F.max_by("score", "_prio").alias("score"), F.max_by("strategy", "_prio").alias("strategy")
    )


def top_k(cands: DataFrame, k: int) -> DataFrame:
    """Per source column and target table, the k best by score desc then target position (TOP-1)."""
    w = Window.partitionBy("src_table", "src_col", "tgt_table").orderBy(F.col("score").desc(), F.col("tgt_pos").asc())
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
