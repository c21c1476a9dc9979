"""End-to-end column matching (RNK-5, RNK-6): ``match_tables`` and ``match_corpus``.

Plan shape for a catalogue of tables:

    cells ─► value_counts (partial agg) ─┬► column_stats ─┐
                                         └► samples ──────┴► profile ─► text ─► n-gram TF-IDF vectors
    columns ─► equal-name / name-similarity candidates ──────────────────────┐
    vectors ─► block top-k cosine (per source column x target table) ────────┴► strategy merge
           ─► top-k per (source column, target table) ─► 1:1 re-rank per table pair ─► matches

The column-level relations (profile, texts, vectors) hold one row per column;
they are checkpointed to the shared checkpoint folder so the driver-side
block sizing does not replay the scan, and so a lost executor does not force
a rescan of the tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import digests as D
from ..operators import llm as J
from ..operators import pooling as PL
from ..operators import profile as P
from ..operators import serialize as Z
from ..operators.rerank import bipartite_rerank
from ..operators.similarity import dense_topk, sparse_topk, tfidf_vectors
from ..session import cut_lineage, prepare
from ..sources.catalog import Table, cells


@dataclass(frozen=True)
class MatchOptions:
    encoding_mode: str = "header_values_verbose"
    sampling_mode: str = "mixed"
    sampling_size: int = 10
    max_context_columns: int | None = 7
    topk: int = 20
    embedding_threshold: float = 0.1
    include_strsim_matches: bool = False
    include_embedding_matches: bool = True
    include_equal_matches: bool = True
    use_bp_reranker: bool = True
    strategy_order: dict | None = None
    tokens: Z.Tokens = field(default_factory=Z.Tokens)
    ngram: int = 3
    checkpoint: bool = True
    query_prefix: str | None = None  # asymmetric retrieval: instruction prepended to source texts only
    # Encoders and judges are functions from DataFrame to DataFrame, so they run where Spark puts them:
    # (col_id, text) -> (col_id, vec ARRAY<DOUBLE>); None: character n-gram TF-IDF
    embed: Callable[[DataFrame], DataFrame] | None = None
    # (item_id, text) -> (item_id, tok_idx, start, end, vec, is_marker): for the span and marker modes,
    # whose tokens are pooled to one vector for each column
    encode_tokens: Callable[[DataFrame], DataFrame] | None = None
    on_missing: str = "error"  # a column whose span or marker was cut off: "error" leaves it out, "first" takes token 0
    # (src_table, src_col, tgt_table, prompt) -> (src_table, src_col, tgt_table, response)
    judge: Callable[[DataFrame], DataFrame] | None = None
    judge_only: bool = False  # every target column is a candidate, only the judge scores

    def with_(self, **kw) -> "MatchOptions":
        return replace(self, **kw)


# Named presets (RNK-6). Those named for a judge or an encoder take it as an argument of ``preset``.
PRESETS = {
    "baseline": MatchOptions(),
    "no_bp": MatchOptions(use_bp_reranker=False),
    "strsim_first": MatchOptions(include_strsim_matches=True),
    "evaluation": MatchOptions(sampling_size=5, use_bp_reranker=False, include_equal_matches=False),
    "judge": MatchOptions(use_bp_reranker=False),
    "judge_only": MatchOptions(judge_only=True),
}


def preset(name: str, **options) -> MatchOptions:
    """A preset with further options; the judge presets need ``judge``."""
    opts = PRESETS[name].with_(**options)
    if name.startswith("judge") and opts.judge is None:
        raise ValueError(f"preset {name!r} needs a judge")
    return opts


def column_profile(tabs: list[Table], opts: MatchOptions) -> DataFrame:
    """``(table_id, col_name, col_pos, kind, semantic_type, n_rows, n_distinct, samples)``."""
    c = cells(tabs, clean=False)
    counts = D.table_digests(tabs, clean=True, seed=42 if opts.sampling_mode in D.DRAWN else None)
    # read by the statistics and by every sampler branch: materialise once
    # (reliable checkpoint) instead of rescanning the tables per branch
    counts = cut_lineage(counts) if opts.checkpoint else counts
    stats = P.column_stats(counts)
    samp = D.samples(counts, c, opts.sampling_size, opts.sampling_mode, clean=True, by_row=all(t.order_key for t in tabs))
    keys = ["table_id", "col_name", "col_pos", "kind"]
    return stats.select(*keys, "semantic_type", "n_rows", "n_nonnull", "n_distinct").join(samp, keys, "left")


def column_texts(profile: DataFrame, opts: MatchOptions) -> DataFrame:
    t = Z.serialize(profile, opts.encoding_mode, opts.tokens, opts.max_context_columns)
    return t.withColumn("col_id", F.xxhash64("table_id", "col_name"))


def column_vectors(texts: DataFrame, opts: MatchOptions) -> DataFrame:
    """``(id, vec)`` from the encoder of ``opts``: pooled tokens, or one vector for each text."""
    if opts.encode_tokens is None:
        return opts.embed(texts.select("col_id", "text")).select(F.col("col_id").alias("id"), "vec").filter(F.col("vec").isNotNull())
    items = texts.withColumnRenamed("col_id", "item_id")
    tokens = opts.encode_tokens(items.select("item_id", "text"))
    if opts.encoding_mode in Z.SPAN_MODES:
        pooled = PL.span_pool(tokens, items.select("item_id", "span_start", "span_end"), opts.on_missing)
    elif opts.encoding_mode in Z.MARKER_MODES:
        pooled = PL.marker_pool(tokens, items.select("item_id", "marker_ordinal"), opts.on_missing)
    else:
        # plain modes have no target span: the mean of all tokens
        spans = items.select("item_id", F.lit(0).alias("span_start"), F.length("text").alias("span_end"))
        pooled = PL.span_pool(tokens, spans, opts.on_missing)
    return pooled.select(F.col("item_id").alias("id"), "vec").filter(F.col("vec").isNotNull())


def _embedding_candidates(texts: DataFrame, src_ids: set, tgt_ids: set, opts: MatchOptions) -> DataFrame:
    src = texts.filter(F.col("table_id").isin(*src_ids))
    tgt = texts.filter(F.col("table_id").isin(*tgt_ids))
    if opts.query_prefix:
        # the source side is encoded as queries: its texts get a prefix and ids of their own
        src = src.withColumn("text", F.concat(F.lit(opts.query_prefix), F.col("text")))
        src = src.withColumn("col_id", F.xxhash64(F.lit("query"), "table_id", "col_name"))
        texts = src.unionByName(tgt)
    if opts.embed is not None or opts.encode_tokens is not None:
        vecs = column_vectors(texts, opts)
        vecs = cut_lineage(vecs) if opts.checkpoint else vecs
        left = vecs.join(src.select(F.col("col_id").alias("id")), "id", "left_semi")
        right = vecs.join(tgt.select(F.col("col_id").alias("id"), "table_id"), "id")
        top = dense_topk(left, right, opts.topk, opts.embedding_threshold, exclude_self=True, right_group="table_id")
    else:
        # the vectors are written once: both sides and every retry read the same
        vecs = tfidf_vectors(texts, "col_id", "text", opts.ngram, materialize_tf=opts.checkpoint)
        vecs = vecs.join(texts.select(F.col("col_id").alias("id"), "table_id"), "id")
        vecs = cut_lineage(vecs) if opts.checkpoint else vecs
        left = vecs.join(src.select(F.col("col_id").alias("id")), "id", "left_semi")
        right = vecs.join(tgt.select(F.col("col_id").alias("id")), "id", "left_semi")
        top = sparse_topk(left, right, opts.topk, opts.embedding_threshold, group_col="table_id")
    lm = src.select(F.col("col_id").alias("lid"), F.col("table_id").alias("src_table"), F.col("col_name").alias("src_col"), F.col("col_pos").alias("src_pos"))
    rm = tgt.select(F.col("col_id").alias("rid"), F.col("table_id").alias("tgt_table"), F.col("col_name").alias("tgt_col"), F.col("col_pos").alias("tgt_pos"))
    return top.join(lm, "lid").join(rm, "rid").select(*C.CAND_COLS[:6], F.lit("embedding").alias("strategy"), "score")


def judged(matches: DataFrame, tabs: list[Table], opts: MatchOptions) -> DataFrame:
    """Scores of the judge where its answer can be read, else the scores of ``matches`` (RNK-4)."""
    raw = cells(tabs, clean=False)
    counts = D.table_digests(tabs)
    counts = cut_lineage(counts) if opts.checkpoint else counts
    samples = D.samples(counts, raw, 10, "priority_sampling", by_row=all(t.order_key for t in tabs))
    answers = opts.judge(J.prompts(matches, samples).select("src_table", "src_col", "tgt_table", "prompt"))
    return J.merge_judgements(matches, cut_lineage(answers) if opts.checkpoint else answers)


def match_catalog(spark: SparkSession, tabs: list[Table], pairs: list[tuple[str, str]], opts: MatchOptions = MatchOptions()) -> DataFrame:
    """Match every (source, target) table pair in ``pairs``; one plan for all pairs."""
    prepare(spark)
    profile = column_profile(tabs, opts)
    texts = column_texts(profile, opts)
    if opts.checkpoint:
        texts = cut_lineage(texts)
    pairs_df = spark.createDataFrame(pairs, "src_table string, tgt_table string")
    src_ids = {p[0] for p in pairs}
    tgt_ids = {p[1] for p in pairs}
    cols = texts.select("table_id", "col_name", "col_pos")
    if opts.judge_only:
        if opts.judge is None:
            raise ValueError("judge_only needs a judge")
        every = C.all_columns(cols, pairs_df)
        return judged(every, tabs, opts).select("src_table", "src_col", "tgt_table", "tgt_col", "score", "rank")
    order = dict(opts.strategy_order) if opts.strategy_order else dict(C.DEFAULT_ORDER)
    if not opts.include_strsim_matches:
        order["strsim"] = -1
    if not opts.include_embedding_matches:
        order["embedding"] = -1
    if not opts.include_equal_matches:
        order["equal"] = -1
    cands = []
    if order.get("strsim", -1) >= 0:
        cands.append(C.strsim_candidates(cols.filter(F.col("table_id").isin(*src_ids)), cols.filter(F.col("table_id").isin(*tgt_ids)), pairs_df))
    if order.get("embedding", -1) >= 0:
        emb = _embedding_candidates(texts, src_ids, tgt_ids, opts)
        cands.append(emb.join(pairs_df, ["src_table", "tgt_table"], "left_semi"))
    if order.get("equal", -1) >= 0:
        cands.append(C.equal_name_candidates(cols.filter(F.col("table_id").isin(*src_ids)), cols.filter(F.col("table_id").isin(*tgt_ids)), pairs_df))
    if not cands:
        return spark.createDataFrame([], "src_table string, src_col string, tgt_table string, tgt_col string, score double, rank int")
    merged = C.merge_strategies(cands, order)
    top = C.top_k(merged, opts.topk)
    if opts.use_bp_reranker:
        top = bipartite_rerank(top)
    w = Window.partitionBy("src_table", "src_col", "tgt_table").orderBy(F.col("score").desc(), F.col("tgt_pos").asc())
    ranked = top.withColumn("rank", F.row_number().over(w)).select("src_table", "src_col", "tgt_table", "tgt_col", "score", "rank")
    if opts.judge is None:
        return ranked
    ranked = cut_lineage(ranked) if opts.checkpoint else ranked
    return judged(ranked, tabs, opts).select(*ranked.columns)


def match_tables(spark: SparkSession, source: Table, target: Table, opts: MatchOptions = MatchOptions()) -> DataFrame:
    return match_catalog(spark, [source, target], [(source.table_id, target.table_id)], opts)


def match_corpus(spark: SparkSession, tabs: list[Table], opts: MatchOptions = MatchOptions()) -> DataFrame:
    """All unordered table pairs (source = the first in catalogue order)."""
    ids = [t.table_id for t in tabs]
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]]
    return match_catalog(spark, tabs, pairs, opts)
