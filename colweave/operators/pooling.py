"""Token pooling for contextual encoders (VEC-2, VEC-3, VEC-4).

Input is a token relation produced by any tokenizer / encoder plug-in:
``tokens(item_id, tok_idx, start, end, vec ARRAY<DOUBLE>[, is_marker])`` with
character offsets into the serialized text. Pooling is joins plus an
element-wise average (``posexplode`` + ``groupBy``); groups are one item's
tokens, bounded by the encoder's maximum length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .similarity import normalize_expr


def _mean_vectors(tv: DataFrame) -> DataFrame:
    """Element-wise mean of ``vec`` per ``item_id``, then L2-normalised."""
    e = tv.select("item_id", F.posexplode("vec").alias("pos", "x"))
    m = e.groupBy("item_id", "pos").agg(F.avg("x").alias("x"))
    arr = m.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
    return arr.select("item_id", normalize_expr("vec").alias("vec"))


def span_pool(tokens: DataFrame, spans: DataFrame, on_missing: str = "error") -> DataFrame:
    """Mean of tokens overlapping ``[span_start, span_end)``, zero-length tokens skipped (VEC-2).

    ``on_missing='first'`` falls back to token 0 (training behaviour);
    ``'error'`` leaves ``vec`` null and ``missing`` true (inference raised there).
    """
    j = tokens.join(spans, "item_id").filter(
        (F.col("end") > F.col("span_start")) & (F.col("start") < F.col("span_end")) & (F.col("start") != F.col("end"))
    )
    pooled = _mean_vectors(j.select("item_id", "vec"))
    out = spans.select("item_id").join(pooled, "item_id", "left")
    if on_missing == "first":
        first = tokens.filter(F.col("tok_idx") == 0).select("item_id", normalize_expr("vec").alias("_first"))
        out = out.join(first, "item_id", "left").select("item_id", F.col("vec").isNull().alias("missing"), F.coalesce("vec", "_first").alias("vec"))
    else:
        out = out.select("item_id", F.col("vec").isNull().alias("missing"), "vec")
    return out


def marker_pool(tokens: DataFrame, ordinals: DataFrame, on_missing: str = "error") -> DataFrame:
    """Vector of the (ordinal+1)-th marker token of each item (VEC-3); fallback as in ``span_pool`` (VEC-4)."""
    w = Window.partitionBy("item_id").orderBy("tok_idx")
    marks = tokens.filter(F.col("is_marker")).withColumn("_k", F.row_number().over(w) - 1)
    j = ordinals.join(marks, (ordinals["item_id"] == marks["item_id"]) & (ordinals["marker_ordinal"] == marks["_k"]), "left").select(
        ordinals["item_id"], marks["vec"]
    )
    if on_missing == "first":
        first = tokens.filter(F.col("tok_idx") == 0).select("item_id", F.col("vec").alias("_first"))
        j = j.join(first, "item_id", "left").select("item_id", F.col("vec").isNull().alias("missing"), F.coalesce("vec", "_first").alias("vec"))
    else:
        j = j.select("item_id", F.col("vec").isNull().alias("missing"), "vec")
    return j.withColumn("vec", F.when(F.col("vec").isNotNull(), normalize_expr("vec")))
