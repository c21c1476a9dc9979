"""From raw documents to packed training sequences, stage by stage.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, all but the last with the columns of ``docs``. ``run``
writes each result as Parquet below the shared checkpoint folder and reads it
back as the next stage's documents, so a lost executor costs at most a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.llm.common import setup, store, table
from colweave.llm.decontam import decontaminated
from colweave.llm.langid import accepted, held_out, train
from colweave.llm.linededup import without_boilerplate
from colweave.llm.neardup import deduplicated
from colweave.llm.packing import packed_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Rejected: no letters, or too few n-grams of the best language."""
    setup(spark)
    return accepted(docs, train(docs.filter(~held_out(F.col("doc_id")))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sources share; ``n_chars`` follows the text.

    A document that consisted of such lines alone goes: its lines stay where they were first.
    """
    setup(spark)
    cleared = without_boilerplate(docs)
    text, changed = F.col("text"), F.col("n_removed") > 0
    cleared = cleared.filter(~changed | (F.length(F.trim(F.translate(text, "\t\n\r", "   "))) > 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleared = cleared.withColumn("n_chars", F.when(changed, F.char_length(text)).otherwise(F.col("n_chars")).cast(kind))
    return cleared.select(*[F.col(f"`{c}`") for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    setup(spark)
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminated(docs, table(setup(spark), sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    setup(spark)
    return packed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The first stage learns a classifier and the last uses a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the rows of the last stage."""
    docs = table(setup(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
