"""Name similarity functions (FN-10, FN-11, FN-12).

``alignment_score`` is pure Catalyst: an ``aggregate`` over the characters of
the shorter name carrying (last matched index, hits). ``fuzzy_ratio`` needs
``difflib`` and runs as an Arrow-batched pandas UDF on candidate pairs only.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .clean import alnum_lower


def alignment_score(a: Column, b: Column, max_distance: int = 2, size_ratio: int = 2) -> Column:
    """Greedy consecutive alignment of two names after alnum-lower pre-processing.

    Scan the shorter string; each character is matched at its first
    occurrence after the last match, and counts only when it lies within
    ``max_distance`` of the last match (any distance for the first match).
    0 when the longer is more than ``size_ratio`` times the shorter.
    """
    s1, s2 = alnum_lower(a), alnum_lower(b)
    shorter = F.when(F.length(s1) <= F.length(s2), s1).otherwise(s2)
    longer = F.when(F.length(s1) <= F.length(s2), s2).otherwise(s1)
    chars = F.filter(F.split(shorter, ""), lambda x: x != "")
    init = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("hits"))

    def step(acc, ch):
        i = F.call_function("locate", ch, longer, acc["last"] + 2) - 1
        ok = (i >= 0) & ((acc["last"] == -1) | (i - acc["last"] <= max_distance))
        return F.when(ok, F.struct(i.alias("last"), (acc["hits"] + 1).alias("hits"))).otherwise(acc)

    hits = F.aggregate(chars, init, step)["hits"]
    ls, ll = F.length(shorter), F.length(longer)
    return (
        F.when(ll > ls * size_ratio, F.lit(0.0))
        .when(ls == 0, F.lit(0.0))
        .otherwise(hits.cast("double") / ls)
    )


def ratio_percent(a: str | None, b: str | None) -> float:
    """Similarity ratio in whole percents / 100; 0 when either side is empty."""
    if not a or not b:
        return 0.0
    r = difflib.SequenceMatcher(None, a, b).ratio()
    return int(round(100 * r)) / 100.0


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio_percent(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_upper_bound(a: Column, b: Column) -> Column:
    """Native upper bound of the ratio: the characters both names have, as often as both have them."""
    la, lb = F.length(a), F.length(b)

    def times(name: Column, ch: Column) -> Column:
        return F.length(name) - F.length(F.replace(name, ch, F.lit("")))

    letters = F.array_distinct(F.filter(F.split(a, ""), lambda x: x != ""))
    shared = F.aggregate(letters, F.lit(0), lambda acc, ch: acc + F.least(times(a, ch), times(b, ch)))
    return F.coalesce(F.try_divide(2.0 * shared, la + lb), F.lit(0.0))
