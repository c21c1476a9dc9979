"""Character n-gram TF-IDF ranking over a set of strings (AGG-9).

Per n in [n_min, n_max] (each n is its own vocabulary, as one vectoriser per n):
text lower-cased, runs of 2+ whitespace collapsed to one space, raw term
counts, smoothed idf ``ln((1+N)/(1+df)) + 1``, L2 norm per document, score =
sum over documents; keep ``score > threshold``.

All steps are explode + ``groupBy``; documents are rows, so work grows with data.
Texts are dealt to tasks by document before their n-grams are formed, about ``TASK_GRAMS``
in a task: they are counted there without a shuffle, and more texts make more tasks, not larger ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: N-grams counted in one task, about.
TASK_GRAMS = 1 << 20


def char_ngrams(df: DataFrame, text_col: str, n_min: int, n_max: int) -> DataFrame:
    """Explode ``(…, n, gram)`` for every character n-gram of ``text_col``.

    All overlapping n-grams of a text come from one regex pass (a zero-width
    lookahead capturing n characters at every position), and only the array
    of grams is exploded, so the text is never copied into generated rows.
    """
    t = F.regexp_replace(F.lower(F.col(text_col)), r"\s\s+", " ")
    keep = [c for c in df.columns if c != text_col]
    base = df.select(*keep, t.alias("_t"))

    def grams(n):
        found = F.regexp_extract_all(F.col("_t"), F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
        return F.transform(found, lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    per_n = [grams(n) for n in range(n_min, n_max + 1)]
    arr = per_n[0] if len(per_n) == 1 else F.flatten(F.array(*per_n))
    return base.select(*keep, F.explode(arr).alias("_g")).select(*keep, "_g.n", "_g.gram")


def ngram_tfidf_scores(docs: DataFrame, group_cols: list[str], doc_col: str, text_col: str,
                       n_min: int = 3, n_max: int = 8, threshold: float = 0.3) -> DataFrame:
    """``(group_cols…, n, ngram, score)`` with ``score > threshold``."""
    docs = docs.filter(F.col(text_col).isNotNull())
    n_docs = docs.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_docs"))
    n_chars = docs.agg(F.sum(F.length(text_col).cast("long"))).first()[0] or 0  # one scalar to the driver
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(n_chars * (n_max - n_min + 1) / TASK_GRAMS))
    dealt = docs.select(*group_cols, doc_col, text_col).repartition(tasks, *group_cols, doc_col)
    grams = char_ngrams(dealt, text_col, n_min, n_max)
    tf = grams.groupBy(*group_cols, doc_col, "n", "gram").agg(F.count(F.lit(1)).alias("tf"))
    df_ = tf.groupBy(*group_cols, "n", "gram").agg(F.count(F.lit(1)).alias("df"))
    w = (
        tf.join(df_, [*group_cols, "n", "gram"])
        .join(n_docs, group_cols)
        .withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0))
    )
    # a document's n-grams stand together; its norm as a table of its own would be copied to every task
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*group_cols, doc_col, "n")))
    scored = (
        w.filter(F.col(doc_col).isNotNull()).withColumn("norm", norm)
        .groupBy(*group_cols, "n", "gram")
        .agg(F.sum(F.col("w") / F.col("norm")).alias("score"))
    )
    return scored.filter(F.col("score") > threshold).withColumnRenamed("gram", "ngram")
