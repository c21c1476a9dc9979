"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads whole driver tables; nothing is capped or sub-sampled.
Column names match the SQL oracles in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import benchgen as BG
from ..operators import candidates as CA
from ..operators import evaluate as EV
from ..operators import llm as LL
from ..operators import digests, ngrams, profile, sampling
from ..operators import serialize as Z
from ..operators import traindata as TD
from ..operators.similarity import dense_topk, minmax_normalize, sparse_topk, tfidf_encoder
from ..session import cut_lineage, prepare
from ..sources.catalog import cells, columns_relation, load_catalog
from . import sweep as SW

R6 = 6  # decimals kept for floating results compared across engines


def _cells(spark, sf, names, clean=True):
    prepare(spark)
    return cells(load_catalog(spark, sf, names), clean=clean)


def q_column_catalog(spark: SparkSession, sf: str) -> DataFrame:
    c = _cells(spark, sf, ["customer", "part"], clean=False)
    return c.groupBy("table_id", "col_name", "col_pos", "kind").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values")
    )


def q_cells_long(spark, sf):
    return _cells(spark, sf, ["customer", "part"], clean=False).select("table_id", "row_id", "col_name", "col_pos", "value")


CLEAN_INPUTS = {"documents": ["source"], "part": ["p_type"], "orders": ["o_orderpriority"]}


def q_clean_values(spark, sf):
    from ..functions.clean import clean_text

    prepare(spark)
    tabs = load_catalog(spark, sf, list(CLEAN_INPUTS), columns=CLEAN_INPUTS)
    raw = cells(tabs, clean=False)
    return raw.groupBy("table_id", "col_name", F.col("value").alias("raw")).agg(F.count(F.lit(1)).alias("cnt")).withColumn(
        "cleaned", clean_text(F.col("raw"))
    )


def _vc(spark, sf, names, keep_null=False):
    """Value counts of cleaned cells (raw values counted first, cleaned once per distinct value)."""
    return profile.value_counts(_cells(spark, sf, names, clean=False), keep_null=keep_null, clean=True)


def q_value_counts(spark, sf):
    vc = digests.value_counts(_cells(spark, sf, ["orders", "events"], clean=False), clean=True)
    return vc.select("table_id", "col_name", "value", "cnt", "first_row")


def _stats(spark, sf, names):
    return profile.column_stats(digests.value_digests(_cells(spark, sf, names, clean=False), clean=True))


def q_distinct_ratio(spark, sf):
    s = _stats(spark, sf, ["orders", "events"])
    return s.select("table_id", "col_name", "n_rows", "n_distinct", F.round("distinct_ratio", R6).alias("distinct_ratio"))


TYPE_TABLES = ["customer", "supplier", "part", "orders", "events", "labels"]


def q_column_types(spark, sf):
    return _stats(spark, sf, TYPE_TABLES).select("table_id", "col_name", "semantic_type")


def q_inferred_types(spark, sf):
    return _stats(spark, sf, TYPE_TABLES).select("table_id", "col_name", "inferred_dtype")


def q_types_to_columns(spark, sf):
    return profile.types_to_columns(_stats(spark, sf, TYPE_TABLES))


def q_declared_types(spark, sf):
    d = profile.declared_types(_cells(spark, sf, TYPE_TABLES, clean=False))
    return d.select("table_id", "col_name", "declared_type")


def q_top_values_json(spark, sf):
    vc = _vc(spark, sf, ["part", "orders"])
    return profile.top_values(vc).select("table_id", "col_name", "value", "cnt")


SAMPLE_TABLES = ["part", "customer", "events"]


def _sample_query(mode):
    def q(spark, sf):
        from ..session import cut_lineage

        raw = _cells(spark, sf, SAMPLE_TABLES, clean=False)
        counts = cut_lineage(digests.table_digests(load_catalog(spark, sf, SAMPLE_TABLES), clean=True, seed=42))  # read by several sampler branches
        s = digests.samples(counts, raw, n=10, mode=mode, clean=True)
        return s.select("table_id", "col_name", F.array_join("samples", " | ").alias("samples"))

    q.__name__ = f"q_sample_{mode}"
    return q


def q_common_prefix(spark, sf):
    c = _cells(spark, sf, ["customer", "supplier", "part"], clean=False).filter(F.col("kind") == "text")
    return profile.common_prefix(c, ["table_id", "col_name"], "value")


def q_char_ngrams_tfidf(spark, sf):
    c = _cells(spark, sf, ["part"], clean=False).filter(F.col("kind") == "text")
    s = ngrams.ngram_tfidf_scores(c, ["col_name"], "row_id", "value", 3, 8, 0.3)
    return s.select("col_name", "n", "ngram", F.round("score", R6).alias("score"))




# ---------------------------------------------------------------- serialization

SER_TABLES = ["customer", "part"]


def _profile(spark, sf, names):
    from .pipeline import MatchOptions, column_profile

    prepare(spark)
    return column_profile(load_catalog(spark, sf, names), MatchOptions())


def _serialize_query(mode):
    extra = {"span": ["span_start", "span_end"], "marker": ["marker_ordinal"]}

    def q(spark, sf):
        out = Z.serialize(_profile(spark, sf, SER_TABLES), mode)
        cols = extra["span"] if mode in Z.SPAN_MODES else extra["marker"] if mode in Z.MARKER_MODES else []
        return out.select("table_id", "col_name", "text", *cols)

    q.__name__ = f"q_serialize_{mode}"
    return q


#: Tables wider than the context window of seven columns, so that the window slides.
WIDE_TABLES = ["lineitem"]
WIDE_MODES = ["table_context_window_target_values", "table_context_window_span", "table_context_window_starmie_marker"]


def _serialize_wide_query(mode):
    extra = {"span": ["span_start", "span_end"], "marker": ["marker_ordinal"]}

    def q(spark, sf):
        out = Z.serialize(_profile(spark, sf, WIDE_TABLES), mode)
        cols = extra["span"] if mode in Z.SPAN_MODES else extra["marker"] if mode in Z.MARKER_MODES else []
        return out.select("table_id", "col_name", "text", *cols)

    q.__name__ = f"q_serialize_wide_{mode}"
    return q


def text_tokens(texts: DataFrame) -> DataFrame:
    """Token relation of texts split at blanks: a plain encoder whose vectors are (length, letters ``e``, first code)."""
    parts = texts.select("item_id", F.split("text", " ", -1).alias("_t"))
    each = parts.select("item_id", "_t", F.posexplode("_t").alias("tok_idx", "_w"))
    start = F.when(F.col("tok_idx") > 0, F.length(F.array_join(F.slice("_t", 1, F.col("tok_idx")), " ")) + 1).otherwise(0)
    vec = F.array(F.length("_w"), F.length("_w") - F.length(F.replace("_w", F.lit("e"), F.lit(""))), F.ascii("_w")).cast("array<double>")
    return each.select("item_id", "tok_idx", start.alias("start"), (start + F.length("_w")).alias("end"), vec.alias("vec"),
                       (F.col("_w").endswith(Z.Tokens().col_marker)).alias("is_marker"))


def _pool_query(mode):
    def q(spark, sf):
        from .pipeline import MatchOptions, column_texts, column_vectors

        opts = MatchOptions(encoding_mode=mode, encode_tokens=text_tokens)
        texts = column_texts(_profile(spark, sf, SER_TABLES), opts)
        v = column_vectors(texts, opts).join(texts.select(F.col("col_id").alias("id"), "table_id", "col_name"), "id")
        return v.select("table_id", "col_name", *[F.round(F.col("vec")[i], R6).alias(f"v{i}") for i in range(3)])

    return q


# ---------------------------------------------------------------- name layer
#: Names taken from rows: the distinct values of these columns, and the words of part names.
NAME_COLUMNS = {"customer": ["c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "nation": ["n_name"],
                "region": ["r_name"], "orders": ["o_orderpriority"]}
EQ_NAMES = ["customer.c_mktsegment", "orders.o_orderpriority", "part.p_name", "part.p_type", "part.words"]
ALIGN_PAIRS = [("customer.c_mktsegment", "part.p_type"), ("part.p_name", "part.p_type"), ("part.p_name", "part.words"), ("part.p_type", "part.words"),
               ("nation.n_name", "region.r_name"), ("supplier.s_name", "nation.n_name"), ("part.p_brand", "supplier.s_name"),
               ("orders.o_orderpriority", "customer.c_mktsegment")]


def _data_columns(spark, sf, names):
    """Columns with a value in some row."""
    filled = _cells(spark, sf, names, clean=False).groupBy("table_id", "col_name", "col_pos").agg(F.count("value").alias("n"))
    return filled.filter("n > 0").drop("n")


def _value_names(spark, sf):
    """Names that rows hold, as columns of one table for each source; positions follow the text."""
    from ..operators.ordering import global_index

    prepare(spark)
    raw = cells(load_catalog(spark, sf, list(NAME_COLUMNS), columns=NAME_COLUMNS), clean=False).filter("value IS NOT NULL")
    names = raw.select(F.concat_ws(".", "table_id", "col_name").alias("table_id"), F.col("value").alias("col_name")).distinct()
    words = names.filter("table_id = 'part.p_name'").select(F.lit("part.words").alias("table_id"), F.explode(F.split("col_name", " ")).alias("col_name"))
    return global_index(names.unionByName(words).distinct(), [F.col("table_id"), F.col("col_name")], "col_pos")


def _pairs_df(spark, pairs):
    return spark.createDataFrame(pairs, "src_table string, tgt_table string")


def q_equal_name_matches(spark, sf):
    cols = _value_names(spark, sf)
    pairs = [(a, b) for i, a in enumerate(EQ_NAMES) for b in EQ_NAMES[i + 1:]]
    m = CA.equal_name_candidates(cols, cols, _pairs_df(spark, pairs))
    return m.select("src_table", "src_col", "tgt_table", "tgt_col", "score")


def q_alignment_scores(spark, sf):
    cols = _value_names(spark, sf)
    p = CA.aligned_pairs(cols, cols, _pairs_df(spark, ALIGN_PAIRS))
    return p.select("src_table", "src_col", "tgt_table", "tgt_col", F.round("alignment", R6).alias("alignment"))


def q_fuzzy_candidates(spark, sf):
    cols = _value_names(spark, sf)
    m = CA.strsim_candidates(cols, cols, _pairs_df(spark, ALIGN_PAIRS))
    return m.select("src_table", "src_col", "tgt_table", "tgt_col", "score")


# ---------------------------------------------------------------- vectors
def _vecs(spark, sf):
    prepare(spark)
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("label"))


def _topk(spark, sf, k, threshold=None):
    v = _vecs(spark, sf)
    return dense_topk(v.select("id", "vec"), v.select("id", "vec"), k, threshold=threshold, exclude_self=True)


def q_cosine_topk(spark, sf):
    t = _topk(spark, sf, 5, 0.1)
    return t.select(F.col("lid").alias("src_id"), F.col("rid").alias("tgt_id"), "rank", F.round("score", R6).alias("score"))


def q_minmax_topk(spark, sf):
    t = minmax_normalize(_topk(spark, sf, 5), ["lid"])
    return t.select(F.col("lid").alias("src_id"), F.col("rid").alias("tgt_id"), "rank", F.round("score", R6).alias("score"))


def q_label_topk_accuracy(spark, sf):
    return EV.label_topk_accuracy(_vecs(spark, sf), (1, 3, 5)).select("k", F.round("accuracy", R6).alias("accuracy"))


def q_embedding_mrr(spark, sf):
    return EV.embedding_mrr(_vecs(spark, sf)).select(F.round("mrr", R6).alias("mrr"))


def q_contrastive_loss(spark, sf):
    return EV.contrastive_loss(_vecs(spark, sf), 0.5).select(F.round("loss", R6).alias("loss"))


def _preds_gt(spark, sf, k=10):
    """Predictions: 10 nearest other vectors; ground truth: (i, i+1) when both share a label."""
    v = _vecs(spark, sf)
    preds = dense_topk(v.select("id", "vec"), v.select("id", "vec"), k, exclude_self=True).select(
        F.col("lid").alias("source"), F.col("rid").alias("target"), "score", "rank"
    )
    preds = cut_lineage(preds)  # ten short rows for each vector, read more than once
    a = v.select(F.col("id").alias("source"), F.col("label").alias("la"))
    b = v.select((F.col("id") - 1).alias("source"), F.col("id").alias("target"), F.col("label").alias("lb"))
    gt = a.join(b, "source").filter(F.col("la") == F.col("lb")).select("source", "target")
    return preds, gt


def _round_all(df):
    return df.select(*[F.round(c, R6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q_ranking_metrics(spark, sf):
    p, g = _preds_gt(spark, sf)
    return _round_all(EV.ranking_metrics(p, g))


def q_ranking_errors(spark, sf):
    p, g = _preds_gt(spark, sf)
    return EV.ranking_errors(p, g)


def q_pairset_metrics(spark, sf):
    p, g = _preds_gt(spark, sf)
    return _round_all(EV.pairset_metrics(p.filter(F.col("rank") == 1), g))


def q_pairset_errors(spark, sf):
    p, g = _preds_gt(spark, sf)
    return EV.pairset_errors(p.filter(F.col("rank") == 1), g)


def q_mrr(spark, sf):
    p, g = _preds_gt(spark, sf)
    return _round_all(EV.mrr(p, g))


def q_mrr_adjusted(spark, sf):
    p, g = _preds_gt(spark, sf)
    return _round_all(EV.mrr_adjusted(p, g))


def q_recall_pairs(spark, sf):
    p, g = _preds_gt(spark, sf)
    return _round_all(EV.recall_pairs(p, g))


def q_recall_topk(spark, sf):
    p, g = _preds_gt(spark, sf)
    return EV.recall_at_topk(p, g, 1).unionByName(EV.recall_at_topk(p, g, 5)).unionByName(EV.recall_at_topk(p, g, 10))


def q_metrics_core(spark, sf):
    p, g = _preds_gt(spark, sf)
    return _round_all(EV.metrics_core(p, g, "all"))


def q_greedy_one_to_one(spark, sf):
    from ..operators.rerank import greedy_one_to_one

    p, _ = _preds_gt(spark, sf)
    m = p.select(
        F.lit("embeddings").alias("src_table"), F.col("source").cast("string").alias("src_col"), F.col("source").cast("int").alias("src_pos"),
        F.lit("embeddings").alias("tgt_table"), F.col("target").cast("string").alias("tgt_col"), F.col("target").cast("int").alias("tgt_pos"),
        "score",
    )
    return greedy_one_to_one(m).select("src_col", "tgt_col", F.round("score", R6).alias("score"))


def q_ngram_cosine_topk(spark, sf):
    """Each benchmark item against all documents: 5 nearest by character 3-gram TF-IDF cosine."""
    prepare(spark)
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select((F.col("item_id") * 2).alias("id"), "text")
    d = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") * 2 + 1).alias("id"), "text")
    # the side is in the id: items are even, documents odd
    encode = tfidf_encoder(b.unionByName(d), "id", "text", 3, materialize_tf=False)
    t = sparse_topk(encode(b), encode(d), 5)
    return t.select(
        (F.col("lid") / 2).cast("long").alias("item_id"), ((F.col("rid") - 1) / 2).cast("long").alias("doc_id"),
        "rank", F.round("score", R6).alias("score"),
    )


# ---------------------------------------------------------------- full matching
def q_strategy_merge(spark, sf):
    from .pipeline import MatchOptions, match_catalog

    prepare(spark)
    tabs = load_catalog(spark, sf, ["customer", "supplier"])
    return match_catalog(spark, tabs, [("customer", "supplier")], MatchOptions(include_strsim_matches=True, use_bp_reranker=False))


def q_match_tables(spark, sf):
    from .pipeline import match_tables

    prepare(spark)
    c, s = load_catalog(spark, sf, ["customer", "supplier"])
    return match_tables(spark, c, s)


def q_match_corpus(spark, sf):
    from .pipeline import match_corpus

    prepare(spark)
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "pages", "benchmark", "conversations"]
    return match_corpus(spark, load_catalog(spark, sf, names))




def q_lineitem_profile(spark, sf):
    """Full profile of the largest table: one value-count pass, one per-column pass."""
    s = _stats(spark, sf, ["lineitem"])
    return s.select("table_id", "col_name", "n_rows", "n_distinct", "semantic_type", "inferred_dtype")




# ---------------------------------------------------------------- training data, augmentation, judges

DV_TABLES = ["part", "orders", "customer"]


def _distinct_values(spark, sf, names=DV_TABLES, limit_distinct=100, keep=50):
    return TD.distinct_values(_vc(spark, sf, names), names, limit_distinct, keep)


def q_distinct_values_json(spark, sf):
    return TD.values_json(_distinct_values(spark, sf))


def q_exact_augmentation(spark, sf):
    a = TD.exact_augmentation(_distinct_values(spark, sf, ["customer", "supplier"]))
    return a.select("col_name", "kind", "name", F.array_join("values", "|").alias("values"))


def q_training_items(spark, sf):
    a = TD.exact_augmentation(_distinct_values(spark, sf, ["customer", "supplier"]))
    t = TD.training_items(a, "exact")
    return t.select("class_id", "kind", "name", F.array_join("values", "|").alias("values"))


def q_augmentation_prompts(spark, sf):
    dv = _distinct_values(spark, sf, ["customer"])
    kinds = _cells(spark, sf, ["customer"], clean=False).select("col_name", "kind").distinct()
    lists = dv.groupBy("col_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("values")
    ).join(kinds, "col_name").withColumn("is_text", F.col("kind") == "text")
    return LL.augmentation_prompts(lists)


def _assistant_turns(spark, sf):
    prepare(spark)
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    return c.filter(F.col("role") == "assistant").select("conv_id", "turn", "text")


def q_augmentation_parse(spark, sf):
    p = TD.parse_alternatives(_assistant_turns(spark, sf), "text")
    return p.select("conv_id", "turn", "idx", "alt_name", F.size("values").alias("n_values"), F.array_join("values", "|").alias("values"))


def q_llm_parse(spark, sf):
    t = _assistant_turns(spark, sf).withColumn("_p", LL.parse_response(F.col("text")))
    return t.select("conv_id", "turn", F.col("_p").isNotNull().alias("parsed"), F.coalesce(F.size("_p"), F.lit(0)).alias("n_entries"))


#: Kinds of answers in ``llm_parse_merge``, by supplier: whole, trailing comma, cut off, a score that is
#: no number, a null score, no score, no list.
ANSWER_KINDS = 7


def _judge_answers(spark, sf):
    """(matches, answers) from lineitem: suppliers' parts scored by orders, judged anew by quantity."""
    prepare(spark)
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    per = li.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).cast("double").alias("score"), F.sum("l_quantity").cast("double").alias("judged"))
    names = [F.lit("supplier").alias("src_table"), F.col("l_suppkey").cast("string").alias("src_col"), F.lit("part").alias("tgt_table")]
    matches = per.select(*names, F.col("l_partkey").cast("string").alias("tgt_col"), "score")
    kind = F.pmod(F.col("l_suppkey"), F.lit(ANSWER_KINDS))
    head = F.concat(F.lit('{"column": "'), F.col("l_partkey").cast("string"), F.lit('"'))
    value = F.when((kind == 3) & (F.col("l_partkey") % 5 == 0), F.lit('"high"')).when((kind == 4) & (F.col("l_partkey") % 5 == 1), F.lit("null")).otherwise(F.col("judged").cast("string"))
    entry = F.when(kind == 5, F.concat(head, F.lit("}"))).otherwise(F.concat(head, F.lit(', "score": '), value, F.lit("}")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", entry.alias("e")))), lambda x: x["e"]), ", ")
    lists = per.groupBy("l_suppkey").agg(body.alias("body"))
    answer = (
        F.when(kind == 1, F.concat(F.lit("Here you are: ["), "body", F.lit(", ]. Anything else?")))
        .when(kind == 2, F.concat(F.lit("["), "body", F.lit(', {"column": "cut of')))
        .when(kind == 6, F.lit("I cannot rank these columns.")).otherwise(F.concat(F.lit("["), "body", F.lit("]")))
    )
    return matches, lists.select(*names, answer.alias("response"))


def q_llm_parse_merge(spark, sf):
    """Answers of a judge, good and broken ones, merged into matches."""
    m = LL.merge_judgements(*_judge_answers(spark, sf))
    return m.select("src_col", "tgt_col", F.round("score", R6).alias("score"), "rank")


def q_augmentation_parse_parts(spark, sf):
    """Alternatives in the requested format, one text for each part size."""
    prepare(spark)
    p = spark.read.parquet(f"{sf}/part.parquet")
    entry = F.concat_ws(", ", F.concat(F.col("p_name"), F.lit("\n")), "p_type", "p_brand")
    texts = p.groupBy("p_size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"]), "; ").alias("text"))
    out = TD.parse_alternatives(texts, "text")
    return out.select("p_size", "idx", "alt_name", F.size("values").alias("n_values"), F.array_join("values", "|").alias("values"))


def q_metrics_core_one_to_one(spark, sf):
    """The core metrics over the greedy 1:1 selection of the predictions."""
    from ..operators.rerank import greedy_one_to_one

    p, g = _preds_gt(spark, sf)
    named = p.select(F.lit("e").alias("src_table"), "source", F.col("source").alias("src_pos"), F.lit("e").alias("tgt_table"), "target", F.col("target").alias("tgt_pos"), "score")
    one = greedy_one_to_one(named.withColumnsRenamed({"source": "src_col", "target": "tgt_col"}))
    return _round_all(EV.metrics_core(one.select(F.col("src_col").alias("source"), F.col("tgt_col").alias("target"), "score"), g, "one_to_one"))


def q_balanced_batches_three(spark, sf):
    v = _vecs(spark, sf)
    return TD.balanced_batches(v.select("id", "label"), 12, 3, 42)


def q_llm_prompts(spark, sf):
    """Judge prompts for customer -> supplier with every target as candidate (language-model-only mode)."""
    raw = _cells(spark, sf, ["customer", "supplier"], clean=False)
    samp = digests.samples(digests.value_digests(raw), raw, 10, "priority_sampling")
    cols = raw.select("table_id", "col_name", "col_pos").distinct()
    pairs = _pairs_df(spark, [("customer", "supplier")])
    src = cols.select(F.col("table_id").alias("src_table"), F.col("col_name").alias("src_col")).join(pairs, "src_table")
    tgt = cols.select(F.col("table_id").alias("tgt_table"), F.col("col_name").alias("tgt_col"), (F.col("col_pos") + 1).alias("rank"))
    # every target column of the pair is a candidate: equi-join on the target table id (schema-sized)
    cands = src.join(tgt, "tgt_table")
    return LL.prompts(cands, samp).select("src_col", "prompt")


def q_value_noise(spark, sf):
    prepare(spark)
    c = cells(load_catalog(spark, sf, ["customer", "part"]), clean=False).filter(F.col("kind") == "text")
    key = F.concat_ws("|", F.col("table_id"), F.col("col_name"), F.col("row_id").cast("string"))
    return c.select("table_id", "row_id", "col_name", "value", BG.noisy_text(F.col("value"), 0.05, 42, key, 4).alias("noisy"))


def q_make_pair(spark, sf):
    prepare(spark)
    (t,) = load_catalog(spark, sf, ["customer"])
    s, g, _ = BG.make_pair(t, BG.SPECS["v5"])
    return BG.pair_cells(s, g)


BLOCK_TABLES = ["customer", "supplier", "part"]
BLOCK_ANCHORS = {"customer": {"c_custkey"}, "supplier": {"s_suppkey"}, "part": {"p_partkey"}}


def _block_query(version, cells_of):
    def q(spark, sf):
        prepare(spark)
        src, tgt, gt = BG.make_block_pair(load_catalog(spark, sf, BLOCK_TABLES), BG.SPECS[version], BLOCK_ANCHORS)
        if cells_of:
            return BG.pair_cells(src, tgt)
        # the truth as the joined blocks show it: both columns and how many rows they fill
        filled = BG.pair_cells(src, tgt).groupBy("side", "col_name").agg(F.count("value").alias("n"))
        s = filled.filter("side = 'source'").select(F.col("col_name").alias("source_column"), F.col("n").alias("n_source"))
        t = filled.filter("side = 'target'").select(F.col("col_name").alias("target_column"), F.col("n").alias("n_target"))
        return gt.join(s, "source_column").join(t, "target_column").select("entity", "role", "source_column", "target_column", "n_source", "n_target")

    return q


GT_ENTITIES = ["customer", "supplier", "part", "nation", "orders"]


def _entity_gt(spark, sf):
    """Ground truth of same-name pairs over several entities; role = name without the table prefix."""
    # one pair whose tables are entity blocks side by side (v4 shape): block concat on the row key
    from ..sources.catalog import Table

    tabs = load_catalog(spark, sf, GT_ENTITIES)
    wide = Table("entities", BG.concat_blocks(tabs), "row_id")
    _, _, gt = BG.make_pair(wide, BG.SPECS["v4"])
    gt = gt.filter(F.col("role") != "row_id")
    owner = _data_columns(spark, sf, GT_ENTITIES).select(F.col("table_id").alias("_entity"), F.col("col_name").alias("role"))
    gt = gt.join(owner, "role").withColumn("entity", F.col("_entity")).drop("_entity")
    return gt.withColumn("role", F.regexp_replace("role", "^[^_]*_", ""))


def q_pair_ground_truth(spark, sf):
    prepare(spark)
    out = None
    for name, spec in [("customer", "v5"), ("part", "v3"), ("supplier", "v1")]:
        (t,) = load_catalog(spark, sf, [name])
        _, _, gt = BG.make_pair(t, BG.SPECS[spec])
        cols = _data_columns(spark, sf, [name]).select(F.col("col_name").alias("role"))
        gt = gt.join(cols, "role", "left_semi").withColumn("spec", F.lit(spec)).drop("pair_id")
        out = gt if out is None else out.unionByName(gt)
    return out


def q_hard_negatives(spark, sf):
    return TD.hard_negatives(_entity_gt(spark, sf))


def q_triplets(spark, sf):
    gt = _entity_gt(spark, sf)
    targets = gt.select("pair_id", "target_column").distinct()
    return TD.triplets(gt, targets, 4, 42)


def q_balanced_batches(spark, sf):
    v = _vecs(spark, sf)
    return TD.balanced_batches(v.select("id", "label"), 16, 2, 42)


def q_triplet_loss(spark, sf):
    v = _vecs(spark, sf)
    t = TD.embedding_triplets(v.select("id", "label"), 42)
    return TD.triplet_loss(t, v).select(F.round("loss", R6).alias("loss"), "n_triplets")


def _gt_prev(spark, sf):
    v = _vecs(spark, sf)
    a = v.select(F.col("id").alias("source"), F.col("label").alias("la"))
    b = v.select((F.col("id") + 1).alias("source"), F.col("id").alias("target"), F.col("label").alias("lb"))
    return a.join(b, "source").filter(F.col("la") == F.col("lb")).select("source", "target")


SWEEP_K = [1, 3, 5, 10]


def q_sweep_pivot(spark, sf):
    p, g_next = _preds_gt(spark, sf)
    long = SW.recall_sweep(p, {"next_same_label": g_next, "prev_same_label": _gt_prev(spark, sf)}, SWEEP_K)
    piv = SW.pivot_metrics(long, [f"top{k}" for k in SWEEP_K])
    return piv.select("benchmark", *[F.round(f"top{k}", R6).alias(f"top{k}") for k in SWEEP_K])


def q_sweep_strategy_orders(spark, sf):
    """Customer against supplier under all 15 strategy orders, from one set of candidates."""
    from ..session import cut_lineage
    from .pipeline import MatchOptions, _embedding_candidates, column_profile, column_texts

    prepare(spark)
    tabs = load_catalog(spark, sf, ["customer", "supplier"])
    opts = MatchOptions()
    texts = cut_lineage(column_texts(column_profile(tabs, opts), opts))
    cols = texts.select("table_id", "col_name", "col_pos")
    src, tgt = cols.filter("table_id = 'customer'"), cols.filter("table_id = 'supplier'")
    pairs = _pairs_df(spark, [("customer", "supplier")])
    cands = CA.strsim_candidates(src, tgt, pairs).unionByName(CA.equal_name_candidates(src, tgt, pairs)).unionByName(
        _embedding_candidates(texts, {"customer"}, {"supplier"}, opts))
    out = SW.strategy_orders(cut_lineage(cands), SW.STRATEGY_ORDERS, opts.topk)
    return out.select("config", "src_col", "tgt_col", "strategy", F.round("score", R6).alias("score"), "rank")


def q_assignment_rescaled(spark, sf):
    from .pipeline import MatchOptions, column_profile, column_texts
    from .pipeline import _embedding_candidates
    from ..operators.candidates import top_k
    from ..operators.rerank import bipartite_rerank

    prepare(spark)
    tabs = load_catalog(spark, sf, ["customer", "supplier"])
    opts = MatchOptions()
    texts = column_texts(column_profile(tabs, opts), opts)
    cands = _embedding_candidates(texts, {"customer"}, {"supplier"}, opts)
    return bipartite_rerank(top_k(cands, opts.topk)).select("src_col", "tgt_col", "score", "assigned")




def q_augment_cells(spark, sf):
    c = _cells(spark, sf, ["customer"], clean=False).select("row_id", "col_name", "col_pos", "value")
    return BG.augment_cells(c, "c_name", 42).select("row_id", "col_name", "value")




FUZZY_GT_TABLES = ["customer", "part", "orders"]


def q_fuzzy_ground_truth(spark, sf):
    """Ground truth of v2-style pairs (typo headers vs generic headers) found by header resemblance."""
    prepare(spark)
    out = None
    for t in load_catalog(spark, sf, FUZZY_GT_TABLES):
        src, tgt, gt = BG.make_pair(t, BG.SPECS["v2"])
        heads = spark.createDataFrame([(i, c) for i, c in enumerate(c for c in src.columns if c != "row_id")], "spos int, source_column string")
        cols = _data_columns(spark, sf, [t.table_id])
        orig = gt.join(cols.select(F.col("col_name").alias("role"), F.col("col_pos").alias("opos")), "role").select(
            "opos", F.col("role").alias("original_column"), F.col("role").alias("base"), "target_column"
        )
        g = BG.fuzzy_ground_truth(heads, orig).withColumn("entity", F.lit(t.table_id))
        out = g if out is None else out.unionByName(g)
    return out




def q_recall_at_gt(spark, sf):
    return EV.recall_at_ground_truth(_vecs(spark, sf)).select(F.round("recall_at_gt", R6).alias("recall_at_gt"))




def q_lowercase_text(spark, sf):
    from ..sources.catalog import lowercase_text

    prepare(spark)
    return lowercase_text(spark.read.parquet(f"{sf}/part.parquet"))


def q_top_pairs_report(spark, sf):
    """The 30 most similar vector pairs overall (global top of the per-item top-30 lists)."""
    t = _topk(spark, sf, 30)
    return t.orderBy(F.col("score").desc(), F.col("lid"), F.col("rid")).limit(30).select(
        F.col("lid").alias("src_id"), F.col("rid").alias("tgt_id"), F.round("score", R6).alias("score")
    )


def q_embedding_eval(spark, sf):
    """Accuracy@1, recall at ground truth, MRR and the selection score (recall + MRR) / 2 (AGG-19)."""
    v = _vecs(spark, sf)
    acc = EV.label_topk_accuracy(v, (1,)).select(F.lit("accuracy_at_1").alias("metric"), F.round("accuracy", R6).alias("value"))
    rec = EV.recall_at_ground_truth(v).select(F.lit("recall_at_gt").alias("metric"), F.round("recall_at_gt", R6).alias("value"))
    mrr = EV.embedding_mrr(v).select(F.lit("mrr").alias("metric"), F.round("mrr", R6).alias("value"))
    both = cut_lineage(rec.unionByName(mrr))  # two rows, read twice
    sel = both.agg(F.round(F.sum("value") / 2.0, R6).alias("value")).select(F.lit("selection_score").alias("metric"), "value")
    return acc.unionByName(both).unionByName(sel)


def q_input_stats(spark, sf):
    from .pipeline import MatchOptions, column_profile, match_tables

    prepare(spark)
    c, s = load_catalog(spark, sf, ["customer", "supplier"])
    m = match_tables(spark, c, s)
    return SW.input_stats(column_profile([c, s], MatchOptions()), m, "customer", "supplier")


def q_sample_priority_murmur3(spark, sf):
    from ..session import cut_lineage

    vc = cut_lineage(_vc(spark, sf, SAMPLE_TABLES))
    s = sampling.samples(vc, n=10, mode="priority_sampling", hash_fn="murmur3")
    return s.select("table_id", "col_name", F.array_join("samples", " | ").alias("samples"))


RESUME_METHODS = ["documents", "characters"]


def q_resume_worklist(spark, sf):
    """Work items (method, source of documents) with the results that a log holds of them after a broken run.

    Batch 0 has half of the sources and is committed; it is run again, which adds
    nothing. Batch 1 stops before its commit, so its items are pending like those never begun.
    """
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..streaming import resultlog as RL

    prepare(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("source IS NOT NULL")
    totals = docs.groupBy(F.col("source").alias("table_id")).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("characters"))
    results = totals.unpivot(["table_id"], RESUME_METHODS, "method", "value")
    part = F.pmod(F.conv(F.substring(F.md5("table_id"), 1, 8), 16, 10).cast("bigint"), F.lit(2))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/colweave-results-{uuid.uuid4().hex}"
    RL.commit_results(results.filter(part == 0), path, "resume", 0)
    RL.commit_results(results.filter(part == 0), path, "resume", 0)
    RL.stage_batch(results.filter((part == 1) & (F.col("method") == "documents")), path, "resume", 1)
    log = RL.committed_results(spark, path, "table_id string, method string, value long")
    items = RL.worklist(totals.select("table_id"), RESUME_METHODS)
    keys = ["method", "table_id"]
    logged = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_results"), F.max("value").alias("value"))
    todo = RL.pending(items, log, keys).select(*keys, F.lit(0).cast("long").alias("n_results"), F.lit(None).cast("long").alias("value"))
    return logged.unionByName(todo).select("method", F.col("table_id").alias("source"), "n_results", "value")


SKETCH_TABLES = ["customer", "orders", "events", "pages"]


def q_distinct_ratio_sketch(spark, sf):
    """Whether a column's distinct values exceed 0.8 of its rows, from sketches stored by append (rows with even and odd keys)."""
    import uuid

    from ..operators import sketches as SK
    from ..session import ensure_checkpoint_dir
    from ..streaming import resultlog as RL

    rows = _cells(spark, sf, SKETCH_TABLES)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/colweave-sketches-{uuid.uuid4().hex}"
    for batch in (0, 1):
        RL.commit_results(SK.column_sketches(rows.filter(F.pmod("row_id", F.lit(2)) == batch)), path, "sketches", batch)
    merged = SK.merged_sketches(RL.committed_results(spark, path, SK.SKETCH_SCHEMA))
    return SK.distinct_decisions(merged, rows).select("table_id", "col_name", "n_rows", "over")


SAMPLE_QUERIES = {
    "sample_frequent": "frequent",
    "sample_mixed": "mixed",
    "sample_random": "random",
    "sample_weighted": "weighted",
    "sample_priority": "priority_sampling",
    "sample_consistent": "consistent_sampling",
}


def registry() -> dict:
    """Every registered query, by name."""
    q = {
        "column_catalog": q_column_catalog,
        "cells_long": q_cells_long,
        "clean_values": q_clean_values,
        "value_counts": q_value_counts,
        "distinct_ratio": q_distinct_ratio,
        "column_types": q_column_types,
        "inferred_types": q_inferred_types,
        "types_to_columns": q_types_to_columns,
        "declared_types": q_declared_types,
        "top_values_json": q_top_values_json,
        "common_prefix": q_common_prefix,
        "char_ngrams_tfidf": q_char_ngrams_tfidf,
        "equal_name_matches": q_equal_name_matches,
        "alignment_scores": q_alignment_scores,
        "fuzzy_candidates": q_fuzzy_candidates,
        "cosine_topk": q_cosine_topk,
        "minmax_topk": q_minmax_topk,
        "label_topk_accuracy": q_label_topk_accuracy,
        "embedding_mrr": q_embedding_mrr,
        "contrastive_loss": q_contrastive_loss,
        "ranking_metrics": q_ranking_metrics,
        "ranking_errors": q_ranking_errors,
        "pairset_metrics": q_pairset_metrics,
        "pairset_errors": q_pairset_errors,
        "mrr": q_mrr,
        "mrr_adjusted": q_mrr_adjusted,
        "recall_pairs": q_recall_pairs,
        "recall_topk": q_recall_topk,
        "metrics_core": q_metrics_core,
        "greedy_one_to_one": q_greedy_one_to_one,
        "ngram_cosine_topk": q_ngram_cosine_topk,
        "strategy_merge": q_strategy_merge,
        "match_tables": q_match_tables,
        "match_corpus": q_match_corpus,
        "lineitem_profile": q_lineitem_profile,
        "distinct_values_json": q_distinct_values_json,
        "exact_augmentation": q_exact_augmentation,
        "training_items": q_training_items,
        "augmentation_prompts": q_augmentation_prompts,
        "augmentation_parse": q_augmentation_parse,
        "llm_parse": q_llm_parse,
        "llm_parse_merge": q_llm_parse_merge,
        "augmentation_parse_parts": q_augmentation_parse_parts,
        "metrics_core_one_to_one": q_metrics_core_one_to_one,
        "balanced_batches_three": q_balanced_batches_three,
        "llm_prompts": q_llm_prompts,
        "value_noise": q_value_noise,
        "make_pair": q_make_pair,
        "pair_ground_truth": q_pair_ground_truth,
        "hard_negatives": q_hard_negatives,
        "triplets": q_triplets,
        "balanced_batches": q_balanced_batches,
        "triplet_loss": q_triplet_loss,
        "sweep_pivot": q_sweep_pivot,
        "assignment_rescaled": q_assignment_rescaled,
        "augment_cells": q_augment_cells,
        "fuzzy_ground_truth": q_fuzzy_ground_truth,
        "recall_at_gt": q_recall_at_gt,
        "lowercase_text": q_lowercase_text,
        "top_pairs_report": q_top_pairs_report,
        "embedding_eval": q_embedding_eval,
        "input_stats": q_input_stats,
        "sample_priority_murmur3": q_sample_priority_murmur3,
    }
    for version in ("v1", "v3", "v4", "v5", "v6"):
        q[f"block_pair_truth_{version}"] = _block_query(version, False)
    q["make_block_pair"] = _block_query("v6", True)
    q["span_pool"] = _pool_query("table_context_window_span")
    q["marker_pool"] = _pool_query("table_context_window_starmie_structured")
    q["sweep_strategy_orders"] = q_sweep_strategy_orders
    q["resume_worklist"] = q_resume_worklist
    q["distinct_ratio_sketch"] = q_distinct_ratio_sketch
    for mode in WIDE_MODES:
        q[f"serialize_wide_{mode}"] = _serialize_wide_query(mode)
    for name, mode in SAMPLE_QUERIES.items():
        q[name] = _sample_query(mode)
    for mode in Z.SIMPLE_MODES + Z.CONTEXT_MODES + Z.SPAN_MODES + Z.MARKER_MODES:
        q[f"serialize_{mode}"] = _serialize_query(mode)
    return q
