"""Registered queries of the text operators: thin wrappers that read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colweave.llm.common import setup, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.langid import identify

    return identify(table(setup(spark), sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.linededup import without_boilerplate

    return without_boilerplate(table(setup(spark), sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "n_lines", "n_removed", "text")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.decontam import contamination

    return contamination(table(setup(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.packing import packed_documents

    return packed_documents(table(setup(spark), sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.neardup import near_duplicates

    return near_duplicates(table(setup(spark), sf_dir, "documents")).drop("text_hash")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(setup(spark), sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.warc import archive_round_trip

    return archive_round_trip(table(setup(spark), sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.tokens import token_counts

    return token_counts(table(setup(spark), sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.quality import quality_rules

    return quality_rules(table(setup(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.lm import score_documents

    return score_documents(table(setup(spark), sf_dir, "documents"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.alignment import alignment

    return alignment(table(setup(spark), sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.merkle import verified_manifest

    return verified_manifest(table(setup(spark), sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colweave.llm.simhash import simhash_components

    return simhash_components(table(setup(spark), sf_dir, "documents"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_line_dedup": op2_line_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_packing": op4_packing,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_sharding": op6_sharding,
        "op7_warc": op7_warc,
        "op8_token_counts": op8_token_counts,
        "op9_quality_rules": op9_quality_rules,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_cross_tokenizer": op11_cross_tokenizer,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_simhash": op13_simhash,
    }
