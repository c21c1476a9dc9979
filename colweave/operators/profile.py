"""Column profiling: value counts, distinct statistics and type detection.

Every statistic comes from one ``groupBy`` over ``cells`` (value counts, map-side
partial aggregation) followed by one ``groupBy`` per column. No window spans a
whole column, so a column holding a third of all rows is still spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clean_text, is_binary_word, is_date_text, is_integer_text, is_number_text
from ..functions.vocab import KEY_AFFIXES
from ..sources.catalog import BOOL, FLOAT, INT, TEXT
from .digests import stats_inputs

COL_KEYS = ["table_id", "col_name", "col_pos", "kind"]


def value_counts(cells: DataFrame, keep_null: bool = False, clean: bool = False) -> DataFrame:
    """``(table_id, col_name, col_pos, kind, value, cnt, first_row)`` (AGG-1).

    With ``keep_null`` the null cells form one extra group per column, which
    lets column statistics count rows including nulls from the same pass.
    With ``clean`` the input holds raw cells: they are counted first (map-side
    partial aggregation on the raw text), the cleaning regexes then run once
    per distinct raw value, and a second aggregation merges raw values that
    clean to the same text.
    """
    vc = cells.groupBy(*COL_KEYS, "value").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("row_id").alias("first_row")
    )
    if clean:
        # only text cells change under cleaning, so only they need the merge
        # aggregation; numeric columns (often most distinct values) skip that shuffle
        text = vc.filter(F.col("kind") == TEXT).withColumn("value", clean_text(F.col("value")))
        text = text.groupBy(*COL_KEYS, "value").agg(F.sum("cnt").alias("cnt"), F.min("first_row").alias("first_row"))
        vc = text.unionByName(vc.filter(F.col("kind") != TEXT))
    return vc if keep_null else vc.filter(F.col("value").isNotNull())


def column_stats(vc_with_null: DataFrame, key_threshold: float = 0.8, datetime_threshold: float = 0.9) -> DataFrame:
    """One row per column with counts, flags, semantic type and inferred dtype.

    Takes value counts with nulls, or value digests (``digests.value_digests``).
    """
    if "digest" in vc_with_null.columns:
        ask = stats_inputs(vc_with_null)
    else:
        v = F.col("value")
        ask = {"nonnull": v.isNotNull(), "number": is_number_text(v), "integer": is_integer_text(v), "date": is_date_text(v), "binary": is_binary_word(v)}
    nonnull = ask["nonnull"]
    text = nonnull & (F.col("kind") == TEXT)
    # text-only tests: for numeric columns the ladder never reaches them, so
    # their (many) distinct values skip the regex and date-parse work
    stats = vc_with_null.groupBy(*COL_KEYS).agg(
        F.sum("cnt").alias("n_rows"),
        F.coalesce(F.sum(F.when(nonnull, F.col("cnt"))), F.lit(0)).alias("n_nonnull"),
        F.count_if(nonnull).alias("n_distinct"),
        F.coalesce(F.max(F.when(nonnull, (F.col("kind") != TEXT) | ask["number"])), F.lit(False)).alias("any_numeric"),
        F.coalesce(F.min(F.when(text, ask["integer"])), F.lit(True)).alias("all_integer_text"),
        F.coalesce(F.sum(F.when(text & ask["binary"], 1)), F.lit(0)).alias("n_binary"),
        F.coalesce(F.sum(F.when(text & ask["date"], F.col("cnt"))), F.lit(0)).alias("n_date"),
    )
    return stats.select(
        "*",
        F.try_divide(F.col("n_distinct"), F.col("n_rows")).alias("distinct_ratio"),
        semantic_type(key_threshold).alias("semantic_type"),
        inferred_dtype(datetime_threshold).alias("inferred_dtype"),
    )


def _name_has_key_affix(name: Column) -> Column:
    low = F.lower(name)
    conds = [low.startswith(a) | low.endswith(a) for a in KEY_AFFIXES]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def semantic_type(key_threshold: float = 0.8) -> Column:
    """AGG-3 ladder over the statistics columns (see README for why it is this short)."""
    name = F.lower(F.col("col_name"))
    ratio = F.try_divide(F.col("n_distinct"), F.col("n_rows"))
    return (
        F.when(F.col("n_rows") == 0, F.lit("unknown"))
        .when(F.col("any_numeric"), F.lit("numerical"))
        .when(name.contains("gene"), F.lit("gene"))
        .when(name.contains("date"), F.lit("date"))
        .when((ratio > F.lit(key_threshold)) & (F.col("kind") != FLOAT), F.lit("key"))
        .when(F.col("n_distinct") == 0, F.lit("unknown"))
        .when(_name_has_key_affix(F.col("col_name")), F.lit("key"))
        .when((F.col("n_distinct") == 2) & (F.col("n_binary") == 2), F.lit("binary"))
        .otherwise(F.lit("categorical"))
    )


def inferred_dtype(datetime_threshold: float = 0.9) -> Column:
    """AGG-4: unknown / integer / float / datetime / categorical."""
    no_nulls = F.col("n_nonnull") == F.col("n_rows")
    integer = no_nulls & (
        (F.col("kind") == INT) | ((F.col("kind") == TEXT) & F.col("all_integer_text"))
    )
    return (
        F.when(F.col("n_nonnull") == 0, F.lit("unknown"))
        .when(F.col("any_numeric") & (F.col("kind") != BOOL), F.when(integer, F.lit("integer")).otherwise(F.lit("float")))
        .when(
            (F.col("n_date") > 0) & (F.try_divide(F.col("n_date"), F.col("n_rows")) >= F.lit(datetime_threshold)),
            F.lit("datetime"),
        )
        .otherwise(F.lit("categorical"))
    )


def declared_types(raw_cells: DataFrame) -> DataFrame:
    """AGG-6: declared type from the first non-null raw value of each column."""
    first = raw_cells.filter(F.col("value").isNotNull()).groupBy(*COL_KEYS).agg(
        F.min_by("value", "row_id").alias("first_value")
    )
    cols = raw_cells.select(*COL_KEYS).distinct()
    joined = cols.join(first, COL_KEYS, "left")
    k = F.col("kind")
    has = F.col("first_value").isNotNull()
    declared = (
        F.when(has & (k == TEXT), F.when(is_date_text(F.col("first_value")), "date").otherwise("varchar"))
        .when(has & (k == INT), F.lit("int"))
        .when(has & (k == FLOAT), F.lit("float"))
        .when(has, F.lit(""))
        .when(k == TEXT, F.lit("varchar"))
        .when(k == INT, F.lit("int64"))
        .when(k == FLOAT, F.lit("float64"))
        .otherwise(F.lit("bool"))
    )
    return joined.select(*COL_KEYS, "first_value", declared.alias("declared_type"))


def types_to_columns(stats: DataFrame) -> DataFrame:
    """AGG-5: per table and type, the columns in schema order."""
    return stats.groupBy("table_id", "semantic_type").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("col_pos", "col_name"))), lambda s: s["col_name"]),
            ",",
        ).alias("columns"),
        F.count(F.lit(1)).alias("n_columns"),
    )


def common_prefix_expr(lo: Column, hi: Column) -> Column:
    """Longest common prefix of two strings (of the min and max of a set: AGG-8)."""
    n = F.least(F.length(lo), F.length(hi))
    eq = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.substring(lo, i, 1) == F.substring(hi, i, 1),
    )
    first_diff = F.array_position(eq, False)
    plen = F.when(n == 0, F.lit(0)).when(first_diff == 0, n).otherwise(first_diff - 1)
    return F.when(lo.isNull() | hi.isNull(), F.lit("")).otherwise(
        F.when(plen <= 0, F.lit("")).otherwise(F.call_function("substr", lo, F.lit(1), plen))
    )


def common_prefix(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """Common prefix of all strings of a group: prefix of min and max."""
    agg = df.groupBy(*group_cols).agg(F.min(value_col).alias("_lo"), F.max(value_col).alias("_hi"))
    return agg.select(
        *group_cols,
        F.coalesce(common_prefix_expr(F.col("_lo"), F.col("_hi")), F.lit("")).alias("prefix"),
    )


def top_values(vc: DataFrame, limit_distinct: int = 100, keep: int = 50) -> DataFrame:
    """AGG-7: every distinct value, but only the ``keep`` most frequent when a column has more than ``limit_distinct``.

    The per-column rank uses a ``row_number`` filter, which Catalyst turns into
    a partial group limit before the shuffle for the ``keep`` case.
    """
    from pyspark.sql import Window as W

    nd = vc.groupBy("table_id", "col_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    j = vc.join(nd, ["table_id", "col_name"])
    small = j.filter(F.col("n_distinct") <= limit_distinct)
    big = j.filter(F.col("n_distinct") > limit_distinct)
    w = W.partitionBy("table_id", "col_name").orderBy(F.col("cnt").desc(), F.col("value").asc())
    big = big.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep).drop("rn")
    return small.unionByName(big)
