"""Deterministic value sampling per column (WIN-4..9).

Input is the non-null value-count relation ``(table_id, col_name, col_pos, kind,
value, cnt, first_row)``. Every mode picks at most ``n`` rows per column with a
``row_number() <= n`` filter, which Catalyst plans as a partial
``WindowGroupLimit`` before the shuffle: a column with billions of distinct
values sends only ``n`` rows per map task. The evenly-spaced part of ``mixed``
needs the first-appearance rank of every distinct value; it is computed in
fixed-width row-id buckets (bounded windows) plus a running count of earlier
buckets, never as one window over a whole column.

Random draws are seeded hashes of the value: results do not depend on
partitioning and can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_unit, murmur3_fraction, seeded_unit
from ..sources.catalog import TEXT

MODES = ("random", "frequent", "mixed", "weighted", "priority_sampling", "consistent_sampling")
KEYS = ["table_id", "col_name", "col_pos", "kind"]
BUCKET_WIDTH = 1 << 20
#: Buckets that a column's row ids are cut into first.
WIDE_BUCKETS = 4096


def _with_n_distinct(vc: DataFrame) -> DataFrame:
    nd = vc.groupBy("table_id", "col_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    return vc.join(nd, ["table_id", "col_name"])


def _top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("table_id", "col_name").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def natural_sort_key() -> Column:
    """Numbers sort as numbers, text as text (pandas sorts the sampled objects)."""
    return F.when(F.col("kind") != TEXT, F.col("value").cast("double"))


def first_appearance_rank(vc: DataFrame, width: int = BUCKET_WIDTH) -> DataFrame:
    """0-based rank of each distinct value by ``first_row`` within its column.

    Buckets of ``width`` row ids hold at most ``width`` values, so the inner
    window is bounded; the offset of a bucket is a running sum over the
    (few) bucket counts of its column.
    """
    b = vc.withColumn("_bkt", F.floor(F.col("first_row") / F.lit(width)))
    counts = b.groupBy("table_id", "col_name", "_bkt").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.partitionBy("table_id", "col_name").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_off", F.coalesce(F.sum("_bn").over(wb), F.lit(0)))
    ties = [c for c in ("value", "short", "digest") if c in vc.columns]
    wi = Window.partitionBy("table_id", "col_name", "_bkt").orderBy("first_row", *ties)
    ranked = b.join(counts, ["table_id", "col_name", "_bkt"]).withColumn(
        "appear_rank", F.col("_off") + F.row_number().over(wi) - 1
    )
    return ranked.drop("_bkt", "_bn", "_off")


def _holding(df: DataFrame, width: Column, parts: int) -> DataFrame:
    """Rows of the buckets of ``width`` row ids that hold a rank to be picked; ``_off`` becomes the values before the bucket."""
    by = ["table_id", "col_name", "_off"]
    b = df.withColumn("_bkt", F.floor(F.col("first_row") / width))
    before = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    counts = b.groupBy(*by, "_step", "_bkt").agg(F.count(F.lit(1)).alias("_bn"))
    counts = counts.withColumn("_start", F.col("_off") + F.coalesce(F.sum("_bn").over(before), F.lit(0)))
    rank = F.col("_start") + F.pmod(-F.col("_start"), F.col("_step"))  # the first to be picked from here on
    hit = counts.filter((rank < F.col("_start") + F.col("_bn")) & (rank < F.col("_step") * F.lit(parts))).select(*by, "_bkt", "_start")
    # at most ``parts`` for each column
    return b.join(F.broadcast(hit), [*by, "_bkt"]).drop("_off", "_bkt").withColumnRenamed("_start", "_off")


def evenly_spread(vc: DataFrame, parts: int, width: int = BUCKET_WIDTH) -> DataFrame:
    """``parts`` values of each column, evenly spread over its values by ``first_row``; needs ``n_distinct``.

    Only buckets that hold a picked rank are sorted: few wide buckets of the column's row ids are counted, then
    buckets of ``width`` ids within those that are hit.
    """
    columns = ["table_id", "col_name"]
    span = vc.groupBy(*columns).agg(((F.max("first_row").cast("double") - F.min("first_row").cast("double")) / F.lit(WIDE_BUCKETS)).alias("_wide"))
    step = F.greatest(F.lit(1), F.floor(F.col("n_distinct") / F.lit(parts)))
    df = vc.join(F.broadcast(span), columns).withColumn("_step", step).withColumn("_off", F.lit(0).cast("long"))
    wide = F.greatest(F.floor("_wide") + 1, F.lit(width))
    near = _holding(_holding(df, wide, parts), F.lit(width), parts)
    ties = [c for c in ("value", "short", "digest") if c in vc.columns]
    w = Window.partitionBy(*columns, "_off").orderBy("first_row", *ties)
    rank = F.col("_off") + F.row_number().over(w) - 1
    ranked = near.withColumn("_rank", rank)
    return ranked.filter((F.pmod("_rank", F.col("_step")) == 0) & (F.col("_rank") < F.col("_step") * F.lit(parts))).select(*vc.columns)


def _hash_fraction(hash_fn: str):
    """Uniform fraction of a value: md5 (SQL-checkable) or exact golden-ratio murmur3 (seed 42)."""
    if hash_fn == "murmur3":
        return murmur3_fraction(F.col("value"))
    return md5_unit(F.col("value"))


def sample_rows(vc: DataFrame, n: int = 10, mode: str = "mixed", seed: int = 42, hash_fn: str = "md5") -> DataFrame:
    """Selected rows plus an ``_ord`` struct that orders them in the output list."""
    if mode not in MODES:
        raise ValueError(f"unsupported sampling mode {mode!r}; use one of {MODES}")
    df = _with_n_distinct(vc)
    small = df.filter(F.col("n_distinct") <= n).withColumn("_ord", F.struct(F.lit(None).cast("double"), F.col("value")))
    big = df.filter(F.col("n_distinct") > n)
    string_order = F.struct(F.lit(None).cast("double"), F.col("value"))
    natural_order = F.struct(natural_sort_key(), F.col("value"))
    if mode == "frequent":
        sel = _top_n(big, n, F.col("cnt").desc(), F.col("value")).withColumn("_ord", natural_order)
    elif mode == "mixed":
        n_freq = n // 2
        n_div = n - n_freq
        freq = _top_n(big, n_freq, F.col("cnt").desc(), F.col("value")) if n_freq > 0 else big.limit(0)
        step = F.greatest(F.lit(1), F.floor(F.col("n_distinct") / F.lit(n_div)))
        ranked = first_appearance_rank(big)
        div = ranked.filter(
            (F.pmod(F.col("appear_rank"), step) == 0) & (F.col("appear_rank") < step * F.lit(n_div))
        ).drop("appear_rank")
        sel = freq.unionByName(div).dropDuplicates(["table_id", "col_name", "value"]).withColumn("_ord", string_order)
    elif mode == "random":
        u = seeded_unit(F.col("value"), seed)
        sel = _top_n(big, n, u.asc(), F.col("value")).withColumn("_ord", natural_order)
    elif mode == "weighted":
        # Efraimidis-Spirakis: n smallest -ln(u)/w is a weighted draw without replacement
        key = -F.log(F.greatest(seeded_unit(F.col("value"), seed), F.lit(1e-12))) / F.col("cnt")
        sel = _top_n(big, n, key.asc(), F.col("value")).withColumn("_ord", F.struct(key, F.col("value")))
    elif mode == "priority_sampling":
        big = big.withColumn("_frac", _hash_fraction(hash_fn))
        prio = F.col("cnt") / F.greatest(F.col("_frac"), F.lit(1e-12))
        sel = _top_n(big, n, prio.desc(), F.col("value")).withColumn("_ord", F.struct(-prio, F.col("value")))
    else:  # consistent_sampling
        big = big.withColumn("_frac", _hash_fraction(hash_fn))
        frac = F.col("_frac")
        sel = _top_n(big, n, frac.desc(), F.col("value")).withColumn("_ord", F.struct(-frac, F.col("value")))
    return small.unionByName(sel.select(*small.columns))


def samples(vc: DataFrame, n: int = 10, mode: str = "mixed", seed: int = 42, hash_fn: str = "md5") -> DataFrame:
    """``(table_id, col_name, col_pos, kind, samples ARRAY<STRING>)`` per column with values."""
    rows = sample_rows(vc, n, mode, seed, hash_fn)
    return rows.groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("_ord").alias("o"), F.col("value").alias("v")))), lambda s: s["v"]).alias(
            "samples"
        )
    )
