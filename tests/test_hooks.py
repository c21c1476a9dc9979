"""Encoders, judges and presets that callers bring along, and the sweep over strategy orders."""

import pytest
from pyspark.sql import functions as F

from colweave.operators import candidates as C
from colweave.plans.pipeline import PRESETS, MatchOptions, column_profile, column_texts, column_vectors, match_tables, preset
from colweave.plans.registry import text_tokens
from colweave.plans.sweep import STRATEGY_ORDERS, strategy_orders
from colweave.sources.catalog import load_catalog

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def tables(spark):
    return load_catalog(spark, SF_SMALL, ["customer", "supplier"])


def letters(texts):
    """Twenty-six letter counts: a plain text encoder."""
    low = F.lower("text")
    counts = [(F.length(low) - F.length(F.replace(low, F.lit(ch), F.lit("")))).cast("double") for ch in "abcdefghijklmnopqrstuvwxyz"]
    return texts.select("col_id", F.array(*counts).alias("vec"))


def test_embedder_takes_the_place_of_ngrams(spark, tables):
    only = MatchOptions(embed=letters, include_equal_matches=False, use_bp_reranker=False, topk=3)
    got = match_tables(spark, *tables, only).collect()
    assert {r["src_col"] for r in got} == set(tables[0].df.columns) and max(r["rank"] for r in got) == 3
    texts = column_texts(column_profile(tables, only), only)
    vec = {r["table_id"] + "." + r["col_name"]: r["vec"] for r in letters(texts).join(texts.select("col_id", "table_id", "col_name"), "col_id").collect()}

    def cosine(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return dot / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    for r in got:
        assert r["score"] == pytest.approx(cosine(vec[f"customer.{r['src_col']}"], vec[f"supplier.{r['tgt_col']}"]))


@pytest.mark.parametrize("mode", ["table_context_window_span", "table_context_window_starmie_marker", "header_values_verbose"])
def test_tokens_are_pooled_in_the_match_path(spark, tables, mode):
    opts = MatchOptions(encoding_mode=mode, encode_tokens=text_tokens, include_equal_matches=False, topk=2)
    texts = column_texts(column_profile(tables, opts), opts)
    assert column_vectors(texts, opts).count() == texts.count()
    got = match_tables(spark, *tables, opts).collect()
    assert got and {r["src_col"] for r in got} <= set(tables[0].df.columns)


def judge_of(answer):
    def judge(prompts):
        assert prompts.columns == ["src_table", "src_col", "tgt_table", "prompt"]
        return prompts.select("src_table", "src_col", "tgt_table", answer(F.col("src_col"), F.col("prompt")).alias("response"))

    return judge


def test_judge_scores_replace_matches(spark, tables):
    best = '[{"column": "s_name", "score": 0.8}, {"column": "s_acctbal", "score": 0.1},]'
    judge = judge_of(lambda col, prompt: F.when(col == "c_name", F.lit(best)).when(prompt.contains("s_nationkey"), F.lit("no idea")))
    got = match_tables(spark, *tables, preset("judge", judge=judge)).collect()
    plain = match_tables(spark, *tables, PRESETS["no_bp"]).collect()
    assert [(r["tgt_col"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["src_col"] == "c_name"] == [("s_name", 0.8), ("s_acctbal", 0.1)]
    assert {(r["src_col"], r["tgt_col"], r["score"]) for r in got if r["src_col"] != "c_name"} == {(r["src_col"], r["tgt_col"], r["score"]) for r in plain if r["src_col"] != "c_name"}


def test_judge_alone_sees_every_target(spark, tables):
    judge = judge_of(lambda col, prompt: F.when(prompt.contains("Column: s_suppkey") & prompt.contains("Column: s_acctbal"), F.lit('[{"column": "s_name", "score": 1}]')))
    got = match_tables(spark, *tables, preset("judge_only", judge=judge)).collect()
    assert {(r["src_col"], r["tgt_col"], r["score"]) for r in got} == {(c, "s_name", 1.0) for c in tables[0].df.columns}


def test_presets_need_their_judge(spark, tables):
    with pytest.raises(ValueError):
        preset("judge")
    with pytest.raises(ValueError):
        match_tables(spark, *tables, PRESETS["judge_only"])


@pytest.mark.parametrize("name", ["baseline", "no_bp", "strsim_first", "evaluation"])
def test_presets_run(spark, tables, name):
    assert match_tables(spark, *tables, preset(name)).count() > 0


def test_strategy_orders_as_one_plan(spark):
    rows = [(f"c{i}", i, f"t{j}", j, s, ((i * 7 + j * 3 + len(s)) % 10) / 10) for i in range(4) for j in range(5) for s in ("strsim", "embedding", "equal") if (i + j + len(s)) % 3]
    cands = spark.createDataFrame([("a", c, i, "b", t, j, s, x) for c, i, t, j, s, x in rows], "src_table string, src_col string, src_pos int, tgt_table string, tgt_col string, tgt_pos int, strategy string, score double")
    got = {}
    for r in strategy_orders(cands, STRATEGY_ORDERS, 3).collect():
        got.setdefault(r["config"], set()).add((r["src_col"], r["tgt_col"], r["score"], r["strategy"], r["rank"]))
    assert len(STRATEGY_ORDERS) == 15 and len({tuple(sorted(o.items())) for o in STRATEGY_ORDERS}) == 15
    for i, order in enumerate(STRATEGY_ORDERS):
        want = C.top_k(C.merge_strategies([cands], order), 3).collect()
        assert got[i] == {(r["src_col"], r["tgt_col"], r["score"], r["strategy"], r["rank"]) for r in want}
