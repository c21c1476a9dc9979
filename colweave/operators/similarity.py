"""Exact similarity joins without a cross join (JOIN-3..6, JOIN-14, VEC-1).

Top-k retrieval goes through ``topk``, which skips blocks by bounds. Passes that need every pair's
score (rank counts, sums, histograms) take block pairs: both sides are cut into hash blocks as large as a task can hold. Each left row is copied
to every right block and vice versa, and one ``groupBy(left_block,
right_block).applyInPandas`` task scores one block pair with a numpy kernel, some left rows at a time, and
hands back one row for each left item. The shuffle carries ``N * Br + M * Bl`` rows, every task holds two bounded
blocks, and no pair row is ever materialised in Spark.

Cosine is computed in float64 on L2-normalised rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows of a block in a block pair, and numbers in it; rows that are worth a block of their own; scores that a kernel gets at once.
DEFAULT_BLOCK_ROWS = 1 << 16
BLOCK_NUMBERS = 1 << 22
PAIR_ROWS = 1024
PAIR_CELLS = 1 << 21


def _assign(df: DataFrame, id_col: str, nb: int, other_nb: int, side: str) -> DataFrame:
    own = F.pmod(F.xxhash64(F.col(id_col)), F.lit(nb)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(other_nb - 1)))
    if side == "L":
        return df.withColumn("_lb", own).withColumn("_rb", other)
    return df.withColumn("_rb", own).withColumn("_lb", other)


def _numbers(left: DataFrame, right: DataFrame) -> str:
    """Type in which vectors are shuffled: as narrow as they come, kernels widen them."""
    narrow = all(df.schema["vec"].dataType.simpleString() == "array<float>" for df in (left, right))
    return "array<float>" if narrow else "array<double>"


TIE_DECIMALS = 12  # scores are ranked after rounding, so float noise never reorders exact ties


def dense_topk(left: DataFrame, right: DataFrame, k: int, threshold: float | None = None,
               exclude_self: bool = False, block_rows: int | None = None,
               right_group: str | None = None) -> DataFrame:
    """Top-k cosine per left item. ``left``/``right``: ``(id BIGINT, vec ARRAY<FLOAT|DOUBLE>)``.

    With ``right_group`` the top-k is kept per (left item, right group).
    Returns ``(lid, rid, score, rank[, rgroup])``.
    """
    from .topk import DENSE_ROWS, Dense, blocked_topk

    numbers = _numbers(left, right)

    def side(df: DataFrame, group) -> DataFrame:
        vec = F.col("vec").cast(numbers)
        return df.select(F.col("id").cast("long").alias("id"), group.alias("grp"), vec.alias("vec")).filter(F.size("vec") > 0)

    grp = F.coalesce(F.col(right_group).cast("string"), F.lit("")) if right_group else F.lit("")
    top = blocked_topk(side(left, F.lit("")), side(right, grp), Dense, k, threshold, exclude_self, block_rows=block_rows or DENSE_ROWS)
    return top if right_group else top.drop("rgroup")


#: Matrix cells a task works on at a time.
CELLS = 4_000_000
#: Terms whose document frequencies are sent to every task (16 bytes each); beyond, they are joined.
VOCABULARY = 4_000_000


def sparse_topk(left: DataFrame, right: DataFrame, k: int, threshold: float | None = None,
                exclude_self: bool = False, group_col: str | None = None) -> DataFrame:
    """Top-k cosine of L2-normalised sparse vectors ``(id, terms ARRAY<BIGINT>, weights ARRAY<DOUBLE>)``.

    With ``group_col`` (present on both sides) the top-k is kept per (left item,
    right group) and items of the same group are never compared.
    Returns ``(lid, rid, score, rgroup, rank)``.

    Right rows lie in blocks on the executors and queries are sent to the blocks that can hold a row
    of their result, see ``topk``; no row of either side passes through the driver.
    """
    from .topk import Sparse, blocked_topk

    def prep(df):
        g = F.coalesce(F.col(group_col).cast("string"), F.lit("")) if group_col else F.lit("")
        return df.select(F.col("id").cast("long").alias("id"), g.alias("grp"), "terms", "weights").filter(F.size("terms") > 0)

    return blocked_topk(prep(left), prep(right), Sparse, k, threshold, exclude_self, by_group=bool(group_col))


def _gram_counts(n: int):
    """Arrow function: the distinct character n-grams of each text and how often they occur.

    Up to three code points fit a BIGINT (21 bits each); longer grams are known by a 64-bit hash.
    """

    def fn(batches):
        import pyarrow as pa

        for b in batches:
            terms, counts = [], []
            for t in b.column("t").to_pylist():
                c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("uint64")
                m = max(0, len(c) - n + 1)
                key = np.zeros(m, dtype="uint64")
                for j in range(n):
                    if n <= 3:
                        key = (key << np.uint64(21)) | c[j : j + m]
                    else:
                        key = (key ^ c[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(29)
                u, k = np.unique(key, return_counts=True)
                terms.append(u.view("int64"))
                counts.append(k.astype("int64"))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in terms])]).astype("int32")
            flat = [np.concatenate(x) if x else np.zeros(0, "int64") for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in flat)], names=["id", "terms", "tfs"])

    return fn


def _weigh(shared, n_docs: int):
    def fn(batches):
        import pyarrow as pa

        known, freq = shared.value
        for b in batches:
            terms = b.column("terms")
            flat, tf = terms.flatten().to_numpy(), b.column("tfs").flatten().to_numpy()
            w = tf * (np.log((1.0 + n_docs) / (1.0 + freq[np.searchsorted(known, flat)])) + 1.0)
            sizes = np.diff(np.asarray(terms.offsets))
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            if len(w):
                w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, starts)), sizes)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(w))],
                names=["id", "terms", "weights"])

    return fn


def tfidf_vectors(docs: DataFrame, id_col: str, text_col: str, n: int = 3, materialize_tf: bool = True) -> DataFrame:
    """Character n-gram TF-IDF, L2-normalised: ``(id, terms, weights)`` (VEC-1 default encoder)."""
    return tfidf_encoder(docs, id_col, text_col, n, materialize_tf)(None)


def tfidf_encoder(docs: DataFrame, id_col: str, text_col: str, n: int = 3, materialize_tf: bool = True):
    """Function from some of the rows of ``docs`` (None: all) to their ``(id, terms, weights)``.

    IDF is fitted on all ``docs`` (both sides of a comparison): smoothed
    ``ln((1+N)/(1+df)) + 1``; text lower-cased, whitespace runs collapsed.
    A text is one row, so its n-grams are counted inside the row and no
    (text, n-gram) pair is shuffled; terms follow from the n-gram's code
    points alone, so a retried task gives the same vectors. Without ``materialize_tf`` the n-grams, many times the
    size of their texts, are counted again where they are read and not stored.
    """
    from ..session import cut_lineage

    t = F.regexp_replace(F.lower(F.col(text_col)), r"\s\s+", " ")

    def counted(some: DataFrame) -> DataFrame:
        d = some.select(F.col(id_col).cast("long").alias("id"), t.alias("t")).filter(F.col("t").isNotNull())
        return d.mapInArrow(_gram_counts(n), "id long, terms array<long>, tfs array<long>")

    counts = cut_lineage(counted(docs)) if materialize_tf else counted(docs)
    n_docs = counts.count() if materialize_tf else docs.filter(F.col(text_col).isNotNull()).count()  # one scalar to the driver
    counts = counts.filter(F.size("terms") > 0)
    freq = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    head = freq.limit(VOCABULARY + 1).toPandas()
    if len(head) <= VOCABULARY:
        head = head.sort_values("term")
        shared = docs.sparkSession.sparkContext.broadcast((head["term"].to_numpy("int64"), head["df"].to_numpy("int64")))
    else:
        # a vocabulary without a small bound is joined; written once, so that Spark splits hot terms
        freq = cut_lineage(freq)

    def encode(some: DataFrame | None) -> DataFrame:
        own = counts if some is None else counted(some).filter(F.size("terms") > 0)
        if len(head) <= VOCABULARY:
            return own.mapInArrow(_weigh(shared, n_docs), "id long, terms array<long>, weights array<double>")
        each = own.select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("id", F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))
        w = each.join(freq, "term").withColumn("w", F.col("tf") * (F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0))
        vec = w.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("e"))
        norm = F.sqrt(F.aggregate(F.col("e.w"), F.lit(0.0), lambda acc, x: acc + x * x))
        return vec.select("id", F.col("e.term").alias("terms"), F.transform(F.col("e.w"), lambda x: x / norm).alias("weights"))

    return encode


def normalize_expr(vec_col: str):
    """L2 normalisation of an array column (FN-28)."""
    v = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: x / norm)


def cosine_expr(a: str, b: str):
    """Cosine of two array columns (FN-29), all Catalyst."""
    va, vb = F.col(a).cast("array<double>"), F.col(b).cast("array<double>")
    dot = F.aggregate(F.zip_with(va, vb, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.sqrt(F.aggregate(va, F.lit(0.0), lambda acc, x: acc + x * x))
    nb = F.sqrt(F.aggregate(vb, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.try_divide(dot, na * nb)


def minmax_normalize(df: DataFrame, part: list[str], score: str = "score") -> DataFrame:
    """Min-max of scores within each group; all equal -> 1.0 (WIN-3). Groups are top-k lists (bounded)."""
    w = Window.partitionBy(*part)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.when(hi == lo, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo)))


def dense_block_apply(left: DataFrame, right: DataFrame, kernel, schema: str,
                      block_rows: int = DEFAULT_BLOCK_ROWS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Run ``kernel(L, R, S)`` on every block pair; ``S`` is the cosine matrix of the pair.

    ``left``/``right`` carry ``id``, ``vec`` and optional columns
    (``label`` BIGINT, ``aux`` DOUBLE, those in ``extra`` BIGINT). The kernel returns partial rows that
    the caller aggregates with ``groupBy`` (sums, maxima), so each task only
    ever holds two bounded blocks; it gets some left rows of the pair at a time. Each side
    is shuffled once for each block of the other, so there are no more blocks than give every task work or fit a task.
    """
    wide = F.max(F.size("vec")).alias("dim")
    sizes = [df.agg(F.count(F.lit(1)).alias("n"), wide).first() for df in (left, right)]
    block_rows = max(1, min(block_rows, BLOCK_NUMBERS // max(1, *[s["dim"] or 0 for s in sizes])))
    least = math.ceil(math.sqrt(2 * left.sparkSession.sparkContext.defaultParallelism))
    bl, br = (max(math.ceil(s["n"] / block_rows), min(least, math.ceil(s["n"] / PAIR_ROWS)), 1) for s in sizes)
    numbers = _numbers(left, right)

    def prep(df):
        cols = [F.col("id").cast("long").alias("id"), F.col("vec").cast(numbers).alias("vec")]
        cols.append((F.col("label") if "label" in df.columns else F.lit(None)).cast("long").alias("label"))
        cols.append((F.col("aux") if "aux" in df.columns else F.lit(None)).cast("double").alias("aux"))
        cols += [(F.col(c) if c in df.columns else F.lit(0)).cast("long").alias(c) for c in extra]
        return df.select(*cols)

    L = _assign(prep(left), "id", bl, br, "L").withColumn("_side", F.lit("L"))
    R = _assign(prep(right), "id", br, bl, "R").withColumn("_side", F.lit("R"))

    def unit(pdf: pd.DataFrame) -> np.ndarray:
        x = np.vstack(pdf["vec"].to_numpy()).astype("float64")
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return x

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        Lp = pdf[pdf["_side"] == "L"].reset_index(drop=True)
        Rp = pdf[pdf["_side"] == "R"].reset_index(drop=True)
        if Lp.empty or Rp.empty:
            return kernel(Lp, Rp, None)
        A, B = unit(Lp), unit(Rp).T
        Lp, Rp = Lp.drop(columns="vec"), Rp.drop(columns="vec")
        step = max(1, PAIR_CELLS // len(Rp))
        parts = [kernel(Lp.iloc[i : i + step].reset_index(drop=True), Rp, A[i : i + step] @ B) for i in range(0, len(Lp), step)]
        return pd.concat(parts, ignore_index=True)

    return L.unionByName(R).groupBy("_lb", "_rb").applyInPandas(fn, schema)
