"""DuckDB SQL oracles for the registered queries.

Each string runs on the driver's pre-registered views (one per test table)
and must return the same columns and rows as the Spark query of the same
name. The SQL restates each rule independently of the Spark code, so the
comparison checks the semantics, not a shared implementation.
"""

from __future__ import annotations

from ..functions.vocab import BINARY_WORDS, DATE_FORMATS, KEY_AFFIXES, NULL_SPELLINGS, PHI_FRACTION
from ..operators.llm import AUG_NO_VALUES, AUG_WITH_VALUES, JUDGE_HEAD, JUDGE_MID, JUDGE_TAIL

# (column, kind, sql type family) for the driver tables, in schema order
SCHEMAS = {
    "region": [("r_regionkey", "int"), ("r_name", "text")],
    "nation": [("n_nationkey", "int"), ("n_name", "text"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "float"), ("c_mktsegment", "text")],
    "supplier": [("s_suppkey", "int"), ("s_name", "text"), ("s_nationkey", "int"), ("s_acctbal", "float")],
    "part": [("p_partkey", "int"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "int"), ("p_retailprice", "float")],
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "text"), ("o_totalprice", "float"), ("o_orderdate", "text"), ("o_orderpriority", "text")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"), ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "text")],
    "events": [("event_id", "int"), ("ts", "text"), ("user_id", "int"), ("event_type", "text"), ("value", "float"), ("props", "text")],
    "documents": [("doc_id", "int"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "int")],
    "labels": [("doc_id", "int"), ("quality", "int"), ("toxic", "int")],
    "pages": [("page_id", "int"), ("url", "text"), ("html", "text")],
    "benchmark": [("item_id", "int"), ("text", "text")],
    "conversations": [("conv_id", "int"), ("turn", "int"), ("role", "text"), ("text", "text")],
}
ROW_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id",
    "pages": "page_id", "benchmark": "item_id",
    "lineitem": "l_orderkey * 65536 + l_linenumber", "conversations": "conv_id * 65536 + turn",
}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


NULLS = in_list(NULL_SPELLINGS)
BINARY = in_list(BINARY_WORDS)
NUM_RE = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
INT_RE = r"^\s*[+-]?\d+\s*$"


def cell_text(col: str, kind: str) -> str:
    if kind == "float":
        return f"CASE WHEN isnan({col}) THEN NULL ELSE CAST({col} AS VARCHAR) END"
    return f"CAST({col} AS VARCHAR)"


def clean(v: str) -> str:
    split = f"regexp_replace({v}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    stripped = f"regexp_replace({split}, '^\\s+|\\s+$', '', 'g')"
    punct = f"regexp_replace(lower({stripped}), '[^a-zA-Z0-9\\s]', ' ', 'g')"
    return f"CASE WHEN {v} IS NULL OR lower({v}) IN {NULLS} THEN NULL ELSE nullif({punct}, '') END"


def cells(tables, clean_text: bool = True, columns: dict | None = None) -> str:
    parts = []
    for t in tables:
        for pos, (c, kind) in enumerate(SCHEMAS[t]):
            if columns and c not in columns.get(t, [c]):
                continue
            v = cell_text(c, kind)
            if clean_text and kind == "text":
                v = clean(v)
            k = "text" if kind == "text" else kind
            parts.append(
                f"SELECT {q(t)} AS table_id, CAST({ROW_KEYS[t]} AS BIGINT) AS row_id, {q(c)} AS col_name, "
                f"{pos} AS col_pos, {q(k)} AS kind, {v} AS value FROM {t}"
            )
    return "\nUNION ALL\n".join(parts)


def is_date(v: str) -> str:
    fmts = "[" + ", ".join(q(f) for _, f in DATE_FORMATS) + "]"
    return f"(regexp_matches({v}, '^\\s*\\d') AND try_strptime(regexp_replace({v}, '^\\s+|\\s+$', '', 'g'), {fmts}) IS NOT NULL)"


def vc(cells_sql: str) -> str:
    return (
        f"SELECT table_id, col_name, col_pos, kind, value, count(*) AS cnt, min(row_id) AS first_row "
        f"FROM ({cells_sql}) GROUP BY table_id, col_name, col_pos, kind, value"
    )


def stats(cells_sql: str) -> str:
    key_conds = " OR ".join(f"starts_with(lower(col_name), {q(a)}) OR ends_with(lower(col_name), {q(a)})" for a in KEY_AFFIXES)
    return f"""
    WITH vc AS ({vc(cells_sql)}),
    st AS (
      SELECT table_id, col_name, col_pos, kind,
        sum(cnt) AS n_rows,
        coalesce(sum(CASE WHEN value IS NOT NULL THEN cnt END), 0) AS n_nonnull,
        count(value) AS n_distinct,
        coalesce(bool_or(CASE WHEN value IS NOT NULL THEN (kind <> 'text' OR regexp_matches(value, '{NUM_RE}')) END), false) AS any_numeric,
        coalesce(bool_and(CASE WHEN value IS NOT NULL THEN regexp_matches(value, '{INT_RE}') END), true) AS all_integer_text,
        coalesce(sum(CASE WHEN value IS NOT NULL AND lower(value) IN {BINARY} THEN 1 END), 0) AS n_binary,
        coalesce(sum(CASE WHEN value IS NOT NULL AND {is_date('value')} THEN cnt END), 0) AS n_date
      FROM vc GROUP BY table_id, col_name, col_pos, kind)
    SELECT *,
      n_distinct / n_rows AS distinct_ratio,
      CASE WHEN n_rows = 0 THEN 'unknown'
           WHEN any_numeric THEN 'numerical'
           WHEN contains(lower(col_name), 'gene') THEN 'gene'
           WHEN contains(lower(col_name), 'date') THEN 'date'
           WHEN n_distinct / n_rows > 0.8 AND kind <> 'float' THEN 'key'
           WHEN n_distinct = 0 THEN 'unknown'
           WHEN {key_conds} THEN 'key'
           WHEN n_distinct = 2 AND n_binary = 2 THEN 'binary'
           ELSE 'categorical' END AS semantic_type,
      CASE WHEN n_nonnull = 0 THEN 'unknown'
           WHEN any_numeric AND kind <> 'bool' THEN
             CASE WHEN n_nonnull = n_rows AND (kind = 'int' OR (kind = 'text' AND all_integer_text)) THEN 'integer' ELSE 'float' END
           WHEN n_date > 0 AND n_date / n_rows >= 0.9 THEN 'datetime'
           ELSE 'categorical' END AS inferred_dtype
    FROM st"""


TYPE_TABLES = ["customer", "supplier", "part", "orders", "events", "labels"]
SAMPLE_TABLES = ["part", "customer", "events"]

U0 = "(('0x' || substr(md5(value), 1, 8))::BIGINT / 4294967296.0)"
U42 = "(('0x' || substr(md5('42:' || value), 1, 8))::BIGINT / 4294967296.0)"


def sample_sql(mode: str, tables=SAMPLE_TABLES, n: int = 10, as_list: bool = False, clean_text: bool = True, unit: str = U0) -> str:
    base = f"""
    WITH vc AS ({vc(cells(tables, clean_text=clean_text))}),
    v AS (SELECT * FROM vc WHERE value IS NOT NULL),
    nd AS (SELECT table_id, col_name, count(*) AS n_distinct FROM v GROUP BY table_id, col_name),
    j AS (SELECT v.*, nd.n_distinct FROM v JOIN nd USING (table_id, col_name))"""
    num = "CASE WHEN kind <> 'text' THEN CAST(value AS DOUBLE) END"
    if mode == "frequent":
        sel = f"""sel AS (SELECT *, CASE WHEN n_distinct > {n} THEN {num} END AS k1 FROM (
              SELECT *, row_number() OVER (PARTITION BY table_id, col_name ORDER BY cnt DESC, value) AS rn FROM j)
              WHERE n_distinct <= {n} OR rn <= {n})"""
    elif mode == "random":
        sel = f"""sel AS (SELECT *, CASE WHEN n_distinct > {n} THEN {num} END AS k1 FROM (
              SELECT *, row_number() OVER (PARTITION BY table_id, col_name ORDER BY {U42}, value) AS rn FROM j)
              WHERE n_distinct <= {n} OR rn <= {n})"""
    elif mode == "weighted":
        key = f"(-ln(greatest({U42}, 1e-12)) / cnt)"
        sel = f"""sel AS (SELECT *, CASE WHEN n_distinct > {n} THEN k END AS k1 FROM (
              SELECT *, {key} AS k, row_number() OVER (PARTITION BY table_id, col_name ORDER BY {key}, value) AS rn FROM j)
              WHERE n_distinct <= {n} OR rn <= {n})"""
    elif mode == "priority_sampling":
        prio = f"(cnt / greatest({unit}, 1e-12))"
        sel = f"""sel AS (SELECT *, CASE WHEN n_distinct > {n} THEN -p END AS k1 FROM (
              SELECT *, {prio} AS p, row_number() OVER (PARTITION BY table_id, col_name ORDER BY {prio} DESC, value) AS rn FROM j)
              WHERE n_distinct <= {n} OR rn <= {n})"""
    elif mode == "consistent_sampling":
        sel = f"""sel AS (SELECT *, CASE WHEN n_distinct > {n} THEN -u END AS k1 FROM (
              SELECT *, {U0} AS u, row_number() OVER (PARTITION BY table_id, col_name ORDER BY {U0} DESC, value) AS rn FROM j)
              WHERE n_distinct <= {n} OR rn <= {n})"""
    elif mode == "mixed":
        nf, ndv = n // 2, n - n // 2
        sel = f"""small AS (SELECT * FROM j WHERE n_distinct <= {n}),
            freq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id, col_name ORDER BY cnt DESC, value) AS rn
                     FROM j WHERE n_distinct > {n}) WHERE rn <= {nf}),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY table_id, col_name ORDER BY first_row, value) - 1 AS ar
                     FROM j WHERE n_distinct > {n}),
            div AS (SELECT * FROM ranked WHERE ar % greatest(1, n_distinct // {ndv}) = 0 AND ar < greatest(1, n_distinct // {ndv}) * {ndv}),
            sel AS (SELECT DISTINCT table_id, col_name, value, CAST(NULL AS DOUBLE) AS k1 FROM (
                SELECT table_id, col_name, value FROM small UNION ALL SELECT table_id, col_name, value FROM freq
                UNION ALL SELECT table_id, col_name, value FROM div))"""
    else:
        raise ValueError(mode)
    agg = "list(value ORDER BY k1 NULLS FIRST, value)" if as_list else "string_agg(value, ' | ' ORDER BY k1 NULLS FIRST, value)"
    return base + "," + sel + f"""
    SELECT table_id, col_name, {agg} AS samples
    FROM sel GROUP BY table_id, col_name"""


def common_prefix_sql(tables) -> str:
    return f"""
    WITH c AS ({cells(tables, clean_text=False)}),
    mm AS (SELECT table_id, col_name, min(value) AS lo, max(value) AS hi FROM c WHERE kind = 'text' GROUP BY table_id, col_name),
    p AS (SELECT table_id, col_name, lo, hi, least(length(lo), length(hi)) AS n FROM mm)
    SELECT table_id, col_name,
      CASE WHEN lo IS NULL OR hi IS NULL OR n = 0 THEN ''
           ELSE substr(lo, 1, coalesce((SELECT min(i) FROM range(1, n + 1) r(i) WHERE substr(lo, i, 1) <> substr(hi, i, 1)) - 1, n)) END AS prefix
    FROM p"""


def ngram_sql(tables, n_min=3, n_max=8, threshold=0.3) -> str:
    return f"""
    WITH c AS ({cells(tables, clean_text=False)}),
    docs AS (SELECT col_name, row_id, regexp_replace(lower(value), '\\s\\s+', ' ', 'g') AS t FROM c WHERE kind = 'text' AND value IS NOT NULL),
    nd AS (SELECT col_name, count(*) AS n_docs FROM docs GROUP BY col_name),
    pos AS (SELECT col_name, row_id, t, n, unnest(range(1, length(t) - n + 2)) AS p FROM docs, range({n_min}, {n_max + 1}) r(n) WHERE length(t) >= n),
    tf AS (SELECT col_name, row_id, n, substr(t, p, n) AS gram, count(*) AS tf FROM pos GROUP BY ALL),
    df AS (SELECT col_name, n, gram, count(*) AS df FROM tf GROUP BY ALL),
    w AS (SELECT tf.*, tf.tf * (ln((1.0 + nd.n_docs) / (1.0 + df.df)) + 1.0) AS w FROM tf JOIN df USING (col_name, n, gram) JOIN nd USING (col_name)),
    norms AS (SELECT col_name, row_id, n, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
    s AS (SELECT col_name, n, gram AS ngram, sum(w / norm) AS score FROM w JOIN norms USING (col_name, row_id, n) GROUP BY ALL)
    SELECT col_name, n, ngram, round(score, 6) AS score FROM s WHERE score > {threshold}"""


def _base_oracles() -> dict:
    cp = cells(["customer", "part"], clean_text=False)
    o = {
        "column_catalog": f"SELECT table_id, col_name, col_pos, kind, count(*) AS n_rows, count(value) AS n_values FROM ({cp}) GROUP BY ALL",
        "cells_long": f"SELECT table_id, row_id, col_name, col_pos, value FROM ({cp})",
        "clean_values": f"""SELECT table_id, col_name, raw, count(*) AS cnt, {clean('raw')} AS cleaned FROM (
            SELECT table_id, col_name, value AS raw FROM ({cells(['documents', 'part', 'orders'], False, {'documents': ['source'], 'part': ['p_type'], 'orders': ['o_orderpriority']})}))
            GROUP BY table_id, col_name, raw""",
        "value_counts": f"SELECT table_id, col_name, value, cnt, first_row FROM ({vc(cells(['orders', 'events']))}) WHERE value IS NOT NULL",
        "distinct_ratio": f"SELECT table_id, col_name, n_rows, n_distinct, round(distinct_ratio, 6) AS distinct_ratio FROM ({stats(cells(['orders', 'events']))})",
        "column_types": f"SELECT table_id, col_name, semantic_type FROM ({stats(cells(TYPE_TABLES))})",
        "inferred_types": f"SELECT table_id, col_name, inferred_dtype FROM ({stats(cells(TYPE_TABLES))})",
        "types_to_columns": f"""SELECT table_id, semantic_type, string_agg(col_name, ',' ORDER BY col_pos) AS columns, count(*) AS n_columns
            FROM ({stats(cells(TYPE_TABLES))}) GROUP BY table_id, semantic_type""",
        "declared_types": f"""WITH c AS ({cells(TYPE_TABLES, clean_text=False)}),
            f AS (SELECT table_id, col_name, kind, arg_min(value, row_id) FILTER (WHERE value IS NOT NULL) AS fv FROM c GROUP BY ALL)
            SELECT table_id, col_name, CASE
              WHEN fv IS NOT NULL AND kind = 'text' THEN CASE WHEN {is_date('fv')} THEN 'date' ELSE 'varchar' END
              WHEN fv IS NOT NULL AND kind = 'int' THEN 'int'
              WHEN fv IS NOT NULL AND kind = 'float' THEN 'float'
              WHEN fv IS NOT NULL THEN ''
              WHEN kind = 'text' THEN 'varchar' WHEN kind = 'int' THEN 'int64' WHEN kind = 'float' THEN 'float64' ELSE 'bool' END AS declared_type
            FROM f""",
        "top_values_json": f"""WITH v AS (SELECT * FROM ({vc(cells(['part', 'orders']))}) WHERE value IS NOT NULL),
            r AS (SELECT *, count(*) OVER (PARTITION BY table_id, col_name) AS nd,
                  row_number() OVER (PARTITION BY table_id, col_name ORDER BY cnt DESC, value) AS rn FROM v)
            SELECT table_id, col_name, value, cnt FROM r WHERE nd <= 100 OR rn <= 50""",
        "common_prefix": common_prefix_sql(["customer", "supplier", "part"]),
        "char_ngrams_tfidf": ngram_sql(["part"]),
    }
    for mode, name in [
        ("frequent", "sample_frequent"), ("mixed", "sample_mixed"), ("random", "sample_random"),
        ("weighted", "sample_weighted"), ("priority_sampling", "sample_priority"), ("consistent_sampling", "sample_consistent"),
    ]:
        o[name] = sample_sql(mode)
    return o


# ------------------------------------------------------------------ batch 2
SER_TABLES = ["customer", "part"]
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def profile_sql(tables) -> str:
    return f"""
    WITH st AS (SELECT * FROM ({stats(cells(tables))})),
    sm AS (SELECT * FROM ({sample_sql('mixed', tables, 10, as_list=True)})),
    p AS (SELECT st.table_id, st.col_name, st.col_pos, st.semantic_type AS y,
                 coalesce(sm.samples, []::VARCHAR[]) AS v
          FROM st LEFT JOIN sm USING (table_id, col_name))"""


def simple_template(mode: str) -> str:
    C, S, E = "'<s>'", "'</s>'", "'</s>'"
    h, y = "col_name", "y"
    j = "array_to_string(v, '</s>')"
    if mode == "header_values_verbose":
        return f"{C} || 'Column: ' || {h} || {S} || 'Type: ' || {y} || {S} || 'Values: ' || {j} || {S}"
    if mode in ("header_values_default", "header_values_default_notype"):
        return f"{C} || {h} || {S} || {y} || {S} || {j}"
    if mode == "header_values_prefix":
        return f"{C} || 'header:' || {h} || {S} || 'datatype:' || {y} || {S} || 'values:' || array_to_string(v, ', ')"
    if mode in ("header_values_repeat", "header_header_values_repeat_notype"):
        rep = f" || {S} || ".join([h] * 5)
        return f"{C} || {rep} || {S} || {y} || {S} || {j}"
    if mode == "header_only":
        return f"{C} || {h} || {E}"
    if mode == "header_values_verbose_notype":
        return f"{C} || 'Column: ' || {h} || {S} || 'Values: ' || {j} || {S} || {E}"
    if mode == "header_values_columnvaluepair_notype":
        pairs = f"array_to_string(list_transform(v, lambda x: {h} || ':' || x), '</s>')"
        return f"{C} || 'Column: ' || {h} || {S} || 'Values: ' || {pairs} || {S} || {E}"
    raise ValueError(mode)


def target_block_sql(repeat: bool) -> str:
    toks = f"list_filter(list_transform(v, lambda x: {STRIP.format(x='x')}), lambda x: x <> '')"
    focus = "'Target Column Focus: ' || col_name || ' [SEP] ' || " if repeat else ""
    return (
        f"('Target Column Name: ' || col_name || ' [SEP] ' || {focus}'Target Column Type: ' || y || ' [SEP] ' || "
        f"'Target Sample Values: ' || CASE WHEN len({toks}) > 0 THEN array_to_string({toks}, ' | ') ELSE 'NONE' END)"
    )


def serialize_sql(mode: str, tables=SER_TABLES, w: int = 7) -> str:
    base = profile_sql(tables)
    if mode == "table_context_target_values":
        listed = "array_to_string(list_transform(headers, lambda x, i: CASE WHEN i - 1 = col_pos THEN '<TARGET> ' || x || ' </TARGET>' ELSE x END), ' | ')"
        text = f"'<s> Contextual Column Representation [SEP] Table Columns: ' || {listed} || ' [SEP] ' || {target_block_sql(False)} || ' </s>'"
    elif mode == "table_context_window_target_values":
        lft, rgt = (w - 1) // 2, w - 1 - (w - 1) // 2
        text = f"""'<s> Windowed Contextual Column Representation [SEP] Left Context Columns: '
            || CASE WHEN len(list_slice(headers, ws + 1, col_pos)) > 0 THEN array_to_string(list_slice(headers, ws + 1, col_pos), ' | ') ELSE 'NONE' END
            || '. Target Marker: <TARGET> ' || col_name || ' </TARGET>. Right Context Columns: '
            || CASE WHEN len(list_slice(headers, col_pos + 2, we)) > 0 THEN array_to_string(list_slice(headers, col_pos + 2, we), ' | ') ELSE 'NONE' END
            || '. [SEP] ' || {target_block_sql(True)} || ' </s>'"""
        return base + f""",
        h AS (SELECT table_id, list(col_name ORDER BY col_pos) AS headers, count(*) AS n FROM p GROUP BY table_id),
        b AS (SELECT p.*, headers, n, greatest(0, col_pos - {lft}) AS s0, least(n, col_pos + {rgt} + 1) AS e0 FROM p JOIN h USING (table_id)),
        b2 AS (SELECT *, {w} - (e0 - s0) AS miss FROM b),
        b3 AS (SELECT *, greatest(0, s0 - miss) AS ns FROM b2),
        b4 AS (SELECT *,
            CASE WHEN {w} >= n THEN 0 WHEN miss > 0 THEN ns ELSE s0 END AS ws,
            CASE WHEN {w} >= n THEN n WHEN miss > 0 THEN least(n, e0 + miss - (s0 - ns)) ELSE e0 END AS we FROM b3)
        SELECT table_id, col_name, {text} AS text FROM b4"""
    else:
        return base + f" SELECT table_id, col_name, {simple_template(mode)} AS text FROM p"
    return base + f""",
        h AS (SELECT table_id, list(col_name ORDER BY col_pos) AS headers FROM p GROUP BY table_id)
        SELECT table_id, col_name, {text} AS text FROM p JOIN h USING (table_id)"""


NAME_COLUMNS = {"customer": ["c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"], "nation": ["n_name"],
                "region": ["r_name"], "orders": ["o_orderpriority"]}
EQ_NAMES = ["customer.c_mktsegment", "orders.o_orderpriority", "part.p_name", "part.p_type", "part.words"]
ALIGN_PAIRS = [("customer.c_mktsegment", "part.p_type"), ("part.p_name", "part.p_type"), ("part.p_name", "part.words"), ("part.p_type", "part.words"),
               ("nation.n_name", "region.r_name"), ("supplier.s_name", "nation.n_name"), ("part.p_brand", "supplier.s_name"),
               ("orders.o_orderpriority", "customer.c_mktsegment")]


def value_names_sql() -> str:
    parts = [f"SELECT DISTINCT {q(t + '.' + c)} AS table_id, {c} AS col_name FROM {t} WHERE {c} IS NOT NULL" for t, cols in NAME_COLUMNS.items() for c in cols]
    return " UNION ALL ".join([*parts, "SELECT DISTINCT 'part.words', unnest(string_split(p_name, ' ')) FROM part"])


def equal_name_sql() -> str:
    pairs = " UNION ALL ".join(f"SELECT {q(a)} AS src_table, {q(b)} AS tgt_table" for i, a in enumerate(EQ_NAMES) for b in EQ_NAMES[i + 1:])
    key = lambda c: f"regexp_replace(lower({STRIP.format(x=c)}), '[^a-zA-Z0-9\\s]', ' ', 'g')"
    return f"""
    WITH c AS ({value_names_sql()}), pr AS ({pairs})
    SELECT s.table_id AS src_table, s.col_name AS src_col, t.table_id AS tgt_table, t.col_name AS tgt_col, CAST(1.0 AS DOUBLE) AS score
    FROM c s JOIN pr ON pr.src_table = s.table_id JOIN c t ON t.table_id = pr.tgt_table AND {key('s.col_name')} = {key('t.col_name')}"""


def alignment_sql() -> str:
    pairs = " UNION ALL ".join(f"SELECT {q(a)} AS src_table, {q(b)} AS tgt_table" for a, b in ALIGN_PAIRS)
    al = lambda c: f"lower(regexp_replace({c}, '[^a-zA-Z0-9]', '', 'g'))"
    return f"""
    WITH c AS ({value_names_sql()}),
    pre AS (SELECT table_id, min(col_name) AS lo, max(col_name) AS hi FROM c GROUP BY table_id),
    pre2 AS (SELECT table_id, CASE WHEN least(length(lo), length(hi)) = 0 THEN '' ELSE substr(lo, 1, coalesce(
        (SELECT min(i) FROM range(1, least(length(lo), length(hi)) + 1) r(i) WHERE substr(lo, i, 1) <> substr(hi, i, 1)) - 1,
        least(length(lo), length(hi)))) END AS prefix FROM pre),
    cp AS (SELECT c.*, CASE WHEN prefix = '' THEN col_name ELSE replace(col_name, prefix, '') END AS prep FROM c JOIN pre2 USING (table_id)),
    pr AS ({pairs}),
    ch AS (SELECT table_id, col_name, prep, unnest(list_distinct(list_filter(str_split(lower(prep), ''), lambda x: x <> ''))) AS chr FROM cp),
    cand AS (SELECT DISTINCT s.table_id AS src_table, s.col_name AS src_col, s.prep AS sp, t.table_id AS tgt_table, t.col_name AS tgt_col, t.prep AS tp
             FROM ch s JOIN pr ON pr.src_table = s.table_id JOIN ch t ON t.table_id = pr.tgt_table AND s.chr = t.chr),
    a1 AS (SELECT *, {al('sp')} AS a, {al('tp')} AS b FROM cand),
    a2 AS (SELECT *, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS sh, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS lg FROM a1),
    a3 AS (SELECT *, list_reduce(list_filter(str_split(sh, ''), lambda x: x <> ''),
        lambda acc, ch: CASE WHEN instr(substr(lg, acc.last + 2), ch) > 0 AND (acc.last = -1 OR instr(substr(lg, acc.last + 2), ch) <= 2)
                        THEN {{'last': acc.last + instr(substr(lg, acc.last + 2), ch), 'hits': acc.hits + 1}} ELSE acc END,
        {{'last': -1, 'hits': 0}}) AS r FROM a2)
    SELECT src_table, src_col, tgt_table, tgt_col, round(r.hits / length(sh), 6) AS alignment
    FROM a3 WHERE length(sh) > 0 AND length(lg) <= 2 * length(sh) AND r.hits / length(sh) >= 0.95"""


EMB = """e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    nr AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM e GROUP BY vec_id),
    dots AS (SELECT a.vec_id AS src, b.vec_id AS tgt, sum(a.x * b.x) AS dot FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL),
    sims AS (SELECT src, tgt, dot / (na.nrm * nb.nrm) AS score FROM dots JOIN nr na ON na.vec_id = src JOIN nr nb ON nb.vec_id = tgt),
    lab AS (SELECT vec_id, label FROM embeddings)"""


def topk_sql(k: int) -> str:
    return f"(SELECT src, tgt, score, row_number() OVER (PARTITION BY src ORDER BY round(score, 12) DESC, tgt) AS rank FROM sims QUALIFY rank <= {k})"


PG = f"""WITH {EMB},
    preds AS (SELECT src AS source, tgt AS target, score, rank FROM {topk_sql(10)}),
    gt AS (SELECT a.vec_id AS source, b.vec_id AS target FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.label = b.label)"""


def balanced_sql(batch_size: int, per_class: int) -> str:
    """Distinct classes of each batch and distinct rows of each class, every index some steps after the one before."""
    classes = batch_size // per_class

    def draws(tag: str, k: int, size: str, *key: str) -> str:
        far = ["0"]
        for j in range(1, k):
            far.append(f"(f{j - 1} + floor({U(q(tag + str(j)), *key)} * ({size} - 1 - f{j - 1} - {k - 1 - j})) + 1)")
        names = ", ".join(f"f{j}" for j in range(k))
        inner = f"SELECT *, 0 AS f0, floor({U(q(tag + '0'), *key)} * {size}) AS first FROM {{source}}"
        for j in range(1, k):
            inner = f"SELECT *, {far[j]} AS f{j} FROM ({inner})"
        return f"SELECT *, CAST(first + far AS BIGINT) % {size} AS pick FROM (SELECT *, unnest([{names}]) AS far FROM ({inner}))"

    return f"""WITH it AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings),
        idx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS gidx, count(*) OVER (PARTITION BY label) AS gsize FROM it) WHERE gsize >= {per_class}),
        labs AS (SELECT label, gsize, row_number() OVER (ORDER BY label) - 1 AS lidx, count(*) OVER () AS n FROM (SELECT DISTINCT label, gsize FROM idx)),
        b AS (SELECT r.b AS batch, (SELECT max(n) FROM labs) AS n FROM range(0, (SELECT count(*) FROM it) // {batch_size}) r(b)),
        c AS ({draws("cls", classes, "n", "batch").replace("{source}", "b")}),
        ch AS (SELECT c.batch, labs.label, labs.gsize FROM c JOIN labs ON labs.lidx = c.pick),
        d AS ({draws("row", per_class, "gsize", "batch", "label").replace("{source}", "ch")})
        SELECT d.batch, d.label, idx.id FROM d JOIN idx ON idx.label = d.label AND idx.gidx = d.pick"""


def oracles_batch2() -> dict:
    o = {}
    from ..operators.serialize import CONTEXT_MODES, SIMPLE_MODES

    for mode in SIMPLE_MODES + CONTEXT_MODES:
        o[f"serialize_{mode}"] = serialize_sql(mode)
    o["equal_name_matches"] = equal_name_sql()
    o["alignment_scores"] = alignment_sql()
    o["cosine_topk"] = f"WITH {EMB} SELECT src AS src_id, tgt AS tgt_id, rank, round(score, 6) AS score FROM {topk_sql(5)} WHERE score >= 0.1"
    o["minmax_topk"] = f"""WITH {EMB}, t AS {topk_sql(5)},
        m AS (SELECT *, min(score) OVER (PARTITION BY src) AS lo, max(score) OVER (PARTITION BY src) AS hi FROM t)
        SELECT src AS src_id, tgt AS tgt_id, rank, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS score FROM m"""
    o["label_topk_accuracy"] = f"""WITH {EMB}, t AS {topk_sql(5)},
        h AS (SELECT l.vec_id AS src,
          max(CASE WHEN t.rank <= 1 AND ll.label = l.label THEN 1 ELSE 0 END) AS h1,
          max(CASE WHEN t.rank <= 3 AND ll.label = l.label THEN 1 ELSE 0 END) AS h3,
          max(CASE WHEN t.rank <= 5 AND ll.label = l.label THEN 1 ELSE 0 END) AS h5
          FROM lab l LEFT JOIN t ON t.src = l.vec_id LEFT JOIN lab ll ON ll.vec_id = t.tgt GROUP BY l.vec_id)
        SELECT 1 AS k, round(avg(h1), 6) AS accuracy FROM h UNION ALL SELECT 3, round(avg(h3), 6) FROM h UNION ALL SELECT 5, round(avg(h5), 6) FROM h"""
    o["embedding_mrr"] = f"""WITH {EMB},
        best AS (SELECT l.vec_id AS src, coalesce(max(s.score) FILTER (WHERE lt.label = l.label), -1.0) AS best
                 FROM lab l LEFT JOIN sims s ON s.src = l.vec_id LEFT JOIN lab lt ON lt.vec_id = s.tgt GROUP BY l.vec_id),
        cnt AS (SELECT b.src, count(s.tgt) FILTER (WHERE s.score > b.best) AS above FROM best b LEFT JOIN sims s ON s.src = b.src GROUP BY b.src)
        SELECT round(avg(1.0 / (above + 1)), 6) AS mrr FROM cnt"""
    o["contrastive_loss"] = f"""WITH {EMB},
        z AS (SELECT s.src, sum(exp(s.score / 0.5)) AS s_all, sum(CASE WHEN a.label = b.label THEN exp(s.score / 0.5) ELSE 0 END) AS s_pos
              FROM sims s JOIN lab a ON a.vec_id = s.src JOIN lab b ON b.vec_id = s.tgt GROUP BY s.src)
        SELECT round(avg(-ln(s_pos / s_all)), 6) AS loss FROM z"""
    o["ranking_metrics"] = f"""{PG},
        cov AS (SELECT DISTINCT source, 1 AS c FROM preds),
        j AS (SELECT gt.*, cov.c, p.rank FROM gt LEFT JOIN cov USING (source) LEFT JOIN preds p USING (source, target))
        SELECT count(*) AS n_ground_truth, round(coalesce(sum(coalesce(c, 0)) / count(*), 0.0), 6) AS coverage,
          round(coalesce(sum(coalesce(1.0 / rank, 0.0)) / count(*), 0.0), 6) AS mrr, round(coalesce(avg(rank), 0.0), 6) AS mean_rank,
          sum(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) AS top1_correct, round(sum(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) / count(*), 6) AS top1_accuracy,
          sum(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) AS top3_correct, round(sum(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) / count(*), 6) AS top3_accuracy,
          sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS top5_correct, round(sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) / count(*), 6) AS top5_accuracy
        FROM j"""
    o["ranking_errors"] = f"""{PG},
        l AS (SELECT source, string_agg(CAST(target AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE rank <= 1) AS t1,
                 string_agg(CAST(target AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE rank <= 3) AS t3,
                 string_agg(CAST(target AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE rank <= 5) AS t5 FROM preds GROUP BY source)
        SELECT gt.source AS source_column, gt.target AS ground_truth_target, l.t1 AS predicted_top1,
          coalesce(l.t3, '') AS predicted_top3, coalesce(l.t5, '') AS predicted_top5, p.rank AS ground_truth_rank,
          coalesce(p.rank = 1, false) AS is_top1_correct, coalesce(p.rank <= 3, false) AS is_top3_correct, p.rank IS NOT NULL AS is_found
        FROM gt LEFT JOIN l USING (source) LEFT JOIN preds p USING (source, target)"""
    o["pairset_metrics"] = f"""{PG},
        pp AS (SELECT DISTINCT source, target FROM preds WHERE rank = 1), g AS (SELECT DISTINCT source, target FROM gt),
        c AS (SELECT (SELECT count(*) FROM pp) AS predicted, (SELECT count(*) FROM g) AS ground_truth,
                     (SELECT count(*) FROM pp JOIN g USING (source, target)) AS correct),
        r AS (SELECT *, coalesce(correct / nullif(predicted, 0), 0.0) AS pr, coalesce(correct / nullif(ground_truth, 0), 0.0) AS rc FROM c)
        SELECT predicted, ground_truth, correct, predicted - correct AS false_positives, ground_truth - correct AS false_negatives,
          round(pr, 6) AS precision, round(rc, 6) AS recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0), 6) AS f1 FROM r"""
    o["pairset_errors"] = f"""{PG},
        pp AS (SELECT DISTINCT source, target FROM preds WHERE rank = 1), g AS (SELECT DISTINCT source, target FROM gt)
        SELECT source AS source_column, target AS target_column, 'false_positive' AS error_type FROM (SELECT * FROM pp EXCEPT SELECT * FROM g)
        UNION ALL
        SELECT source, target, 'false_negative' FROM (SELECT * FROM g EXCEPT SELECT * FROM pp)"""
    o["mrr"] = f"{PG} SELECT round(avg(coalesce(1.0 / p.rank, 0.0)), 6) AS mrr FROM gt LEFT JOIN preds p USING (source, target)"
    o["mrr_adjusted"] = f"""{PG},
        s AS (SELECT DISTINCT source FROM preds WHERE source IN (SELECT source FROM gt)),
        b AS (SELECT source, min(rank) AS best FROM preds WHERE (source, target) IN (SELECT (source, target) FROM gt) GROUP BY source)
        SELECT round(avg(coalesce(1.0 / b.best, 0.0)), 6) AS mrr_adjusted FROM s LEFT JOIN b USING (source)"""
    o["recall_pairs"] = f"""{PG},
        g AS (SELECT least(CAST(source AS VARCHAR), CAST(target AS VARCHAR)) AS a, greatest(CAST(source AS VARCHAR), CAST(target AS VARCHAR)) AS b, count(*) AS c FROM gt GROUP BY ALL),
        p AS (SELECT DISTINCT least(CAST(source AS VARCHAR), CAST(target AS VARCHAR)) AS a, greatest(CAST(source AS VARCHAR), CAST(target AS VARCHAR)) AS b, 1 AS hit FROM preds)
        SELECT round(coalesce(count(p.hit) / sum(g.c), 0.0), 6) AS recall FROM g LEFT JOIN p USING (a, b)"""
    o["recall_topk"] = f"""{PG}, g AS (SELECT DISTINCT source, target FROM gt),
        ks AS (SELECT * FROM (VALUES (1), (5), (10)) v(k)),
        j AS (SELECT ks.k, g.source, g.target, max(CASE WHEN p.rank <= ks.k THEN 1 ELSE 0 END) AS hit
              FROM ks, g LEFT JOIN preds p USING (source, target) GROUP BY ALL)
        SELECT k, round(sum(hit) / count(*), 3) AS recall FROM j GROUP BY k"""
    o["metrics_core"] = f"""{PG},
        p AS (SELECT DISTINCT source, target, score FROM preds), g AS (SELECT DISTINCT source, target FROM gt),
        n AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng),
        r AS (SELECT p.*, row_number() OVER (ORDER BY score DESC, source, target) AS rn, (g.source IS NOT NULL) AS hit FROM p LEFT JOIN g USING (source, target)),
        a AS (SELECT count(*) FILTER (WHERE hit) AS h_all,
              count(*) FILTER (WHERE hit AND rn <= (SELECT ceil(0.1 * np) FROM n)) AS h_10,
              count(*) FILTER (WHERE hit AND rn <= (SELECT ng FROM n)) AS h_g FROM r),
        m AS (SELECT a.*, h_all / np AS pr, h_all / ng AS rc, ceil(0.1 * np) AS m10, ng FROM a, n)
        SELECT 'all' AS scope, round(pr, 6) AS precision, round(rc, 6) AS recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0), 6) AS f1,
          round(h_10 / m10, 6) AS precision_top10pct, round(h_g / ng, 6) AS recall_at_gt FROM m"""
    o["ngram_cosine_topk"] = """
    WITH docs AS (SELECT item_id * 2 AS id, text FROM benchmark UNION ALL SELECT doc_id * 2 + 1, text FROM documents),
    d AS (SELECT id, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS t FROM docs WHERE text IS NOT NULL),
    nd AS (SELECT count(*) AS n FROM d),
    pos AS (SELECT id, t, unnest(range(1, length(t) - 1)) AS p FROM d WHERE length(t) >= 3),
    tf AS (SELECT id, substr(t, p, 3) AS gram, count(*) AS tf FROM pos GROUP BY ALL),
    df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
    w AS (SELECT tf.id, tf.gram, tf.tf * (ln((1.0 + (SELECT n FROM nd)) / (1.0 + df.df)) + 1.0) AS w FROM tf JOIN df USING (gram)),
    nrm AS (SELECT id, sqrt(sum(w * w)) AS nr FROM w GROUP BY id),
    wn AS (SELECT w.id, w.gram, w.w / nrm.nr AS w FROM w JOIN nrm USING (id)),
    l AS (SELECT * FROM wn WHERE id % 2 = 0), r AS (SELECT * FROM wn WHERE id % 2 = 1),
    s AS (SELECT l.id AS lid, r.id AS rid, sum(l.w * r.w) AS score FROM l JOIN r USING (gram) GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY round(score, 12) DESC, rid) AS rank FROM s QUALIFY rank <= 5)
    SELECT CAST(lid / 2 AS BIGINT) AS item_id, CAST((rid - 1) / 2 AS BIGINT) AS doc_id, rank, round(score, 6) AS score FROM t"""
    return o


def _extend_oracles_batch1(o: dict) -> dict:
    o.update(oracles_batch2())
    return o


def _extend_oracles_2(o: dict) -> dict:
    o["lineitem_profile"] = f"SELECT table_id, col_name, n_rows, n_distinct, semantic_type, inferred_dtype FROM ({stats(cells(['lineitem']))})"
    return o


# ------------------------------------------------------------------ batch 3

ALPHA37 = "abcdefghijklmnopqrstuvwxyz0123456789 "
ALPHA36 = "abcdefghijklmnopqrstuvwxyz0123456789"


def U(*parts) -> str:
    """md5 unit of '42:' || parts joined by '|' (parts are SQL expressions)."""
    return f"(('0x' || substr(md5('42:' || concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"


def dv_sql(tables, limit_distinct=100, keep=50) -> str:
    order = " ".join(f"WHEN {q(t)} THEN {i}" for i, t in enumerate(tables))
    return f"""
    WITH v AS (SELECT * FROM ({vc(cells(tables))}) WHERE value IS NOT NULL),
    own AS (SELECT col_name, arg_min(table_id, o) AS table_id FROM (SELECT DISTINCT table_id, col_name, CASE table_id {order} END AS o FROM v) GROUP BY col_name),
    vv AS (SELECT v.* FROM v JOIN own USING (col_name, table_id)),
    r AS (SELECT *, count(*) OVER (PARTITION BY col_name) AS nd, row_number() OVER (PARTITION BY col_name ORDER BY cnt DESC, value) AS pos FROM vv)
    SELECT col_name, table_id, value, cnt, pos FROM r WHERE nd <= {limit_distinct} OR pos <= {keep}"""


def exact_aug_sql(tables) -> str:
    c = "col_name"
    pos = f"(floor({U(c, q('pos'))} * length({c}))::BIGINT + 1)"
    ch = f"substr({q(ALPHA37)}, floor({U(c, q('chr'))} * 37)::BIGINT + 1, 1)"
    replaced = f"(substr({c}, 1, {pos} - 1) || {ch} || substr({c}, {pos} + 1))"
    alt = f"CASE WHEN {U(c, q('rename'))} < 0.3 OR n < 1 THEN {replaced} ELSE {c} END"

    def draw(tag, size):
        return f"list_slice(list_transform(list_sort(list_transform(vals, lambda x: {{'k': {U(c, q(tag), 'x')}, 'v': x}})), lambda s: s.v), 1, {size})"

    cap = f"least(n, 15)"
    k1 = f"(floor({U(c, q('k1'))} * {cap})::BIGINT + 1)"
    k2 = f"(floor({U(c, q('k2'))} * {cap})::BIGINT + 1)"
    return f"""
    WITH dv AS ({dv_sql(tables)}),
    l AS (SELECT col_name, list(value ORDER BY pos) AS vals, count(*) AS n FROM dv GROUP BY col_name),
    e AS (
      SELECT col_name, 'original' AS kind, col_name AS name, CASE WHEN n < 15 THEN vals ELSE {draw('orig', 15)} END AS vals FROM l
      UNION ALL SELECT col_name, 'exact', col_name || '_1', CASE WHEN n < 1 THEN []::VARCHAR[] ELSE {draw('s1', k1)} END FROM l
      UNION ALL SELECT col_name, 'exact', {alt} || '_2', CASE WHEN n < 1 THEN []::VARCHAR[] ELSE {draw('s2', k2)} END FROM l)"""


def llm_prompts_sql() -> str:
    return f"""
    WITH sm AS ({sample_sql('priority_sampling', ['customer', 'supplier'], 10, as_list=True, clean_text=False)}),
    lines AS (SELECT table_id, col_name, 'Column: ' || col_name || ', Sample values: [' || array_to_string(coalesce(samples, []::VARCHAR[]), ',') || ']' AS line FROM sm),
    cols AS (SELECT DISTINCT table_id, col_name, col_pos FROM ({cells(['customer', 'supplier'], clean_text=False)})),
    tg AS (SELECT string_agg(l.line, chr(10) ORDER BY c.col_pos) AS targets FROM cols c JOIN lines l USING (table_id, col_name) WHERE c.table_id = 'supplier')
    SELECT c.col_name AS src_col, {q(JUDGE_HEAD)} || l.line || {q(JUDGE_MID)} || tg.targets || {q(JUDGE_TAIL)} AS prompt
    FROM cols c JOIN lines l USING (table_id, col_name), tg WHERE c.table_id = 'customer'"""


def header_order_sql(table: str, side: str, prefix: str | None) -> str:
    rows = " UNION ALL ".join(f"SELECT {q(c)} AS orig" for c, _ in SCHEMAS[table])
    new = f"{q(prefix)} || CAST(row_number() OVER (ORDER BY md5('42|{side}|' || orig), orig) AS VARCHAR)" if prefix else "orig"
    return f"SELECT orig, {new} AS new FROM ({rows})"


def noisy_sql(v: str, key: str, p: float, min_len: int) -> str:
    u = lambda tag: f"(('0x' || substr(md5('42:' || concat_ws('|', {q(tag)}, {key})), 1, 8))::BIGINT / 4294967296.0)"
    pos = f"(floor({u('pos')} * length({v}))::BIGINT + 1)"
    ch = f"substr({q(ALPHA36)}, floor({u('chr')} * 36)::BIGINT + 1, 1)"
    return f"CASE WHEN {v} IS NOT NULL AND length({v}) >= {min_len} AND {u('p')} < {p} THEN substr({v}, 1, {pos} - 1) || {ch} || substr({v}, {pos} + 1) ELSE {v} END"


def make_pair_sql(table: str, spec) -> str:
    parts = []
    for side, prefix, p in (("source", spec.src_prefix, spec.src_noise), ("target", spec.tgt_prefix, spec.tgt_noise)):
        for c, kind in SCHEMAS[table]:
            v = f"CAST({c} AS VARCHAR)"
            if kind == "text" and p > 0:
                v = noisy_sql(v, f"concat_ws('|', {q(side)}, {q(c)}, CAST({ROW_KEYS[table]} AS VARCHAR))", p, spec.min_len)
            parts.append(f"SELECT {q(side)} AS side, CAST({ROW_KEYS[table]} AS BIGINT) AS row_id, {q(c)} AS orig, {v} AS value FROM {table}")
    hs = f"SELECT 'source' AS side, * FROM ({header_order_sql(table, 'source', spec.src_prefix)}) UNION ALL SELECT 'target', * FROM ({header_order_sql(table, 'target', spec.tgt_prefix)})"
    return f"SELECT c.side, c.row_id, h.new AS col_name, c.value FROM ({' UNION ALL '.join(parts)}) c JOIN ({hs}) h USING (side, orig)"


BLOCK_TABLES = ["customer", "supplier", "part"]


def block_pair_sql(spec) -> tuple[str, str]:
    """(cells of both sides, headers): blocks side by side, rows in key order, shorter blocks padded."""
    import hashlib

    cells_, heads = [], []
    order = sorted(BLOCK_TABLES, key=lambda t: (hashlib.md5(f"42|block|{t}".encode()).hexdigest(), t))
    most = "greatest(" + ", ".join(f"(SELECT count(*) FROM {t})" for t in BLOCK_TABLES) + ")"
    for side, prefix, p, tables in (("source", spec.src_prefix, spec.src_noise, BLOCK_TABLES), ("target", spec.tgt_prefix, spec.tgt_noise, order)):
        for i, t in enumerate(tables, start=1):
            for j, (c, kind) in enumerate(SCHEMAS[t], start=1):
                v = f"CAST({c} AS VARCHAR)"
                if kind == "text" and p > 0:
                    v = noisy_sql(v, f"concat_ws('|', {q(side)}, {q(c)}, CAST({ROW_KEYS[t]} AS VARCHAR))", p, spec.min_len)
                new = f"{prefix}{i}_{j}" if prefix else c
                cells_.append(f"SELECT {q(side)} AS side, r.r AS row_id, {q(new)} AS col_name, x.value FROM range(0, {most}) r(r) "
                              f"LEFT JOIN (SELECT row_number() OVER (ORDER BY {ROW_KEYS[t]}) - 1 AS k, {v} AS value FROM {t}) x ON x.k = r.r")
                heads.append(f"SELECT {q(side)} AS side, {q(t)} AS entity, {q(c)} AS role, {q(new)} AS new, {str(j == 1).lower()} AS anchor")
    return " UNION ALL ".join(cells_), " UNION ALL ".join(heads)


def block_truth_sql(spec) -> str:
    cells_, heads = block_pair_sql(spec)
    return f"""WITH c AS (SELECT side, col_name, count(value) AS n FROM ({cells_}) GROUP BY ALL), h AS ({heads})
        SELECT s.entity, s.role, s.new AS source_column, t.new AS target_column, cs.n AS n_source, ct.n AS n_target
        FROM h s JOIN h t ON s.side = 'source' AND t.side = 'target' AND s.entity = t.entity AND s.role = t.role AND NOT s.anchor
        JOIN c cs ON cs.side = 'source' AND cs.col_name = s.new JOIN c ct ON ct.side = 'target' AND ct.col_name = t.new"""


def gt_sql(table: str, spec, spec_name: str | None = None) -> str:
    s = header_order_sql(table, "source", spec.src_prefix)
    t = header_order_sql(table, "target", spec.tgt_prefix)
    tag = f", {q(spec_name)} AS spec" if spec_name else ""
    return f"SELECT s.orig AS role, s.new AS source_column, t.new AS target_column, {q(table)} AS entity{tag} FROM ({s}) s JOIN ({t}) t USING (orig)"


def entity_gt_sql() -> str:
    from ..operators.benchgen import SPECS

    parts = [gt_sql(t, SPECS["v4"]) for t in ["customer", "supplier", "part", "nation", "orders"]]
    return f"SELECT source_column, target_column, entity, regexp_replace(role, '^[^_]*_', '') AS role FROM ({' UNION ALL '.join(parts)})"


def oracles_batch3() -> dict:
    from ..operators.benchgen import SPECS

    o = {}
    o["distinct_values_json"] = f"""WITH dv AS ({dv_sql(['part', 'orders', 'customer'])})
        SELECT col_name, to_json(map([col_name], [list(value ORDER BY pos)])) AS json FROM dv GROUP BY col_name"""
    o["exact_augmentation"] = f"{exact_aug_sql(['customer', 'supplier'])} SELECT col_name, kind, name, array_to_string(vals, '|') AS values FROM e"
    o["training_items"] = f"""{exact_aug_sql(['customer', 'supplier'])},
        f AS (SELECT * FROM e WHERE instr('exact', kind) > 0 OR kind = 'original'),
        cl AS (SELECT col_name, dense_rank() OVER (ORDER BY col_name) - 1 AS class_id FROM (SELECT DISTINCT col_name FROM f))
        SELECT class_id, kind, CASE WHEN kind = 'exact' THEN regexp_replace(name, '_[^_]*$', '') ELSE name END AS name,
          array_to_string(list_filter(list_transform(vals, lambda x: {clean('x')}), lambda x: x IS NOT NULL), '|') AS values
        FROM f JOIN cl USING (col_name)"""
    head_rest = AUG_WITH_VALUES.split("{values}", 1)[1]
    none_rest = AUG_NO_VALUES.split("'{name}'", 1)[1]
    o["augmentation_prompts"] = f"""WITH dv AS ({dv_sql(['customer'])}),
        k AS (SELECT DISTINCT col_name, kind FROM ({cells(['customer'], clean_text=False)})),
        l AS (SELECT col_name, list(value ORDER BY pos) AS vals FROM dv GROUP BY col_name)
        SELECT col_name, CASE WHEN len(vals) > 0 THEN 'Given the table column ''' || col_name || ''' with values ['
          || array_to_string(list_transform(vals, lambda v: CASE WHEN kind = 'text' THEN '''' || v || '''' ELSE v END), ', ') || ']' || {q(head_rest)}
          ELSE 'Given the table column ''' || col_name || '''' || {q(none_rest)} END AS prompt
        FROM l JOIN k USING (col_name)"""
    o["augmentation_parse"] = """
        WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
        l AS (SELECT conv_id, turn, string_split(text, '; ') AS parts FROM a),
        e AS (SELECT conv_id, turn, unnest(parts) AS m, generate_subscripts(parts, 1) - 1 AS idx FROM l),
        f AS (SELECT conv_id, turn, idx, replace(m, chr(10), '') AS m FROM e),
        g AS (SELECT *, instr(m, ', ') AS p FROM f)
        SELECT conv_id, turn, idx, CASE WHEN p > 0 THEN substr(m, 1, p - 1) ELSE m END AS alt_name,
          CASE WHEN p > 0 THEN len(string_split(substr(m, p + 2), ', ')) ELSE 0 END AS n_values,
          CASE WHEN p > 0 THEN array_to_string(string_split(substr(m, p + 2), ', '), '|') ELSE '' END AS values
        FROM g"""
    o["llm_parse"] = r"""
        WITH a AS (SELECT conv_id, turn, coalesce(regexp_extract(text, '(?s)\[.*\]', 0), '') AS js FROM conversations WHERE role = 'assistant')
        , b AS (SELECT conv_id, turn, js, CASE WHEN js = '' THEN false WHEN NOT json_valid(js) THEN false ELSE json_type(js) = 'ARRAY' END AS ok FROM a)
        SELECT conv_id, turn, ok AS parsed, CASE WHEN ok THEN json_array_length(js) ELSE 0 END AS n_entries FROM b"""
    o["llm_prompts"] = llm_prompts_sql()
    key = "concat_ws('|', table_id, col_name, CAST(row_id AS VARCHAR))"
    o["value_noise"] = f"""SELECT table_id, row_id, col_name, value, {noisy_sql('value', key, 0.05, 4)} AS noisy
        FROM ({cells(['customer', 'part'], clean_text=False)}) WHERE kind = 'text'"""
    o["make_pair"] = make_pair_sql("customer", SPECS["v5"])
    o["make_block_pair"] = block_pair_sql(SPECS["v6"])[0]
    for version in ("v1", "v3", "v4", "v5", "v6"):
        o[f"block_pair_truth_{version}"] = block_truth_sql(SPECS[version])
    o["pair_ground_truth"] = " UNION ALL ".join(
        f"SELECT role, source_column, target_column, entity, spec FROM ({gt_sql(t, SPECS[sp], sp)})" for t, sp in [("customer", "v5"), ("part", "v3"), ("supplier", "v1")]
    )
    o["hard_negatives"] = f"""WITH gt AS ({entity_gt_sql()})
        SELECT DISTINCT a.source_column, a.target_column, b.target_column AS negative
        FROM gt a JOIN gt b ON a.role = b.role AND a.entity <> b.entity WHERE b.target_column <> a.target_column"""
    o["triplets"] = f"""WITH gt AS ({entity_gt_sql()}),
        hard AS (SELECT DISTINCT a.source_column, a.target_column, b.target_column AS negative, 0 AS prio
                 FROM gt a JOIN gt b ON a.role = b.role AND a.entity <> b.entity WHERE b.target_column <> a.target_column),
        tc AS (SELECT DISTINCT target_column AS negative FROM gt),
        pos AS (SELECT DISTINCT source_column, target_column FROM gt),
        oth AS (SELECT pos.source_column, pos.target_column, tc.negative, 1 AS prio FROM pos, tc WHERE tc.negative <> pos.target_column),
        c AS (SELECT source_column, target_column, negative, min(prio) AS prio FROM (SELECT * FROM hard UNION ALL SELECT * FROM oth) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY source_column, target_column ORDER BY prio, {U('source_column', 'target_column', 'negative')}, negative) AS rn FROM c)
        SELECT source_column, target_column AS positive_target_col, negative AS negative_target_col, prio AS is_random FROM r WHERE rn <= 4"""
    o["balanced_batches"] = balanced_sql(16, 2)
    o["balanced_batches_three"] = balanced_sql(12, 3)
    o["llm_parse_merge"] = """
        WITH p AS (SELECT l_suppkey, l_partkey, count(*)::DOUBLE AS score, sum(l_quantity)::DOUBLE AS judged, l_suppkey % 7 AS kind FROM lineitem GROUP BY ALL),
        k AS (SELECT *, kind IN (0, 1, 2, 5) OR (kind = 3 AND NOT bool_or(l_partkey % 5 = 0) OVER w) OR (kind = 4 AND NOT bool_or(l_partkey % 5 = 1) OVER w) AS readable
              FROM p WINDOW w AS (PARTITION BY l_suppkey)),
        s AS (SELECT l_suppkey, l_partkey::VARCHAR AS tgt_col, CASE WHEN NOT readable THEN score WHEN kind = 5 THEN 0.0 ELSE judged END AS score FROM k)
        SELECT l_suppkey::VARCHAR AS src_col, tgt_col, round(score, 6) AS score, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, tgt_col) AS rank FROM s"""
    o["augmentation_parse_parts"] = """
        SELECT p_size, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS idx, p_name AS alt_name, 2 AS n_values, p_type || '|' || p_brand AS values FROM part"""
    o["triplet_loss"] = f"""WITH it AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings),
        idx AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS gidx, count(*) OVER (PARTITION BY label) AS gsize FROM it),
        labs AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS lidx, count(*) OVER () AS n_labels FROM (SELECT DISTINCT label FROM it)),
        a AS (SELECT idx.id AS anchor, idx.label, idx.gidx, idx.gsize, labs.lidx, labs.n_labels FROM idx JOIN labs USING (label) WHERE gsize >= 2 AND n_labels >= 2),
        a2 AS (SELECT anchor, label,
                 CAST((gidx + 1 + floor({U(q('p'), 'anchor')} * (gsize - 1))) AS BIGINT) % gsize AS p_idx,
                 CAST((lidx + 1 + floor({U(q('nl'), 'anchor')} * (n_labels - 1))) AS BIGINT) % n_labels AS n_lidx FROM a),
        t AS (SELECT a2.anchor, p.id AS positive, nl.label AS n_label FROM a2 JOIN idx p ON p.label = a2.label AND p.gidx = a2.p_idx JOIN labs nl ON nl.lidx = a2.n_lidx),
        ns AS (SELECT DISTINCT label AS n_label, gsize AS n_size FROM idx),
        t2 AS (SELECT t.*, CAST(floor({U(q('n'), 'anchor')} * n_size) AS BIGINT) AS ngidx FROM t JOIN ns USING (n_label)),
        tr AS (SELECT t2.anchor, t2.positive, n.id AS negative FROM t2 JOIN idx n ON n.label = t2.n_label AND n.gidx = t2.ngidx),
        nv AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_reduce(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y), lambda p, q: p + q, 0.0))) AS v FROM embeddings),
        dists AS (SELECT tr.anchor,
                    sqrt(list_reduce(list_transform(list_zip(a.v, p.v), lambda z: (z[1] - z[2] + 1e-6) * (z[1] - z[2] + 1e-6)), lambda s, t: s + t, 0.0)) AS dap,
                    sqrt(list_reduce(list_transform(list_zip(a.v, n.v), lambda z: (z[1] - z[2] + 1e-6) * (z[1] - z[2] + 1e-6)), lambda s, t: s + t, 0.0)) AS dan
                  FROM tr JOIN nv a ON a.vec_id = tr.anchor JOIN nv p ON p.vec_id = tr.positive JOIN nv n ON n.vec_id = tr.negative)
        SELECT round(avg(greatest(0.0, dap - dan + 0.2)), 6) AS loss, count(*) AS n_triplets FROM dists"""
    o["sweep_pivot"] = f"""{PG},
        gp AS (SELECT a.vec_id AS source, b.vec_id AS target FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1 AND a.label = b.label),
        g AS (SELECT DISTINCT 'next_same_label' AS benchmark, source, target FROM gt UNION ALL SELECT DISTINCT 'prev_same_label', source, target FROM gp),
        j AS (SELECT g.benchmark, p.rank FROM g LEFT JOIN preds p USING (source, target))
        SELECT benchmark,
          round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3,
          round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS top10
        FROM j GROUP BY benchmark"""
    return o


def _extend_oracles_3(o: dict) -> dict:
    o.update(oracles_batch3())
    return o


# ------------------------------------------------------------------ span / marker modes
def _window_cte(w: int = 7) -> str:
    lft, rgt = (w - 1) // 2, w - 1 - (w - 1) // 2
    toks = f"list_filter(list_transform(v, lambda x: {STRIP.format(x='x')}), lambda x: x <> '')"
    return f""",
    toks AS (SELECT *, {toks} AS tk FROM p),
    blk AS (SELECT *,
        array_to_string(list_concat(['<<COL>>', col_name], tk), ' | ') AS b_marker,
        '<<COL>> ; header = ' || col_name || ' ; type = ' || y || ' ; values = ' || CASE WHEN len(tk) > 0 THEN array_to_string(tk, ' ; ') ELSE 'NONE' END AS b_struct
        FROM toks),
    h AS (SELECT table_id, list(col_name ORDER BY col_pos) AS headers, list(b_marker ORDER BY col_pos) AS bm,
                 list(b_struct ORDER BY col_pos) AS bs, count(*) AS n FROM blk GROUP BY table_id),
    b AS (SELECT blk.*, headers, bm, bs, n, greatest(0, col_pos - {lft}) AS s0, least(n, col_pos + {rgt} + 1) AS e0 FROM blk JOIN h USING (table_id)),
    b2 AS (SELECT *, {w} - (e0 - s0) AS miss FROM b),
    b3 AS (SELECT *, greatest(0, s0 - miss) AS ns FROM b2),
    b4 AS (SELECT *,
        CASE WHEN {w} >= n THEN 0 WHEN miss > 0 THEN ns ELSE s0 END AS ws,
        CASE WHEN {w} >= n THEN n WHEN miss > 0 THEN least(n, e0 + miss - (s0 - ns)) ELSE e0 END AS we FROM b3),
    b5 AS (SELECT *,
        CASE WHEN len(list_slice(headers, ws + 1, col_pos)) > 0 THEN array_to_string(list_slice(headers, ws + 1, col_pos), ' | ') ELSE 'NONE' END AS lt,
        CASE WHEN len(list_slice(headers, col_pos + 2, we)) > 0 THEN array_to_string(list_slice(headers, col_pos + 2, we), ' | ') ELSE 'NONE' END AS rt,
        CASE WHEN len(tk) > 0 THEN array_to_string(tk, ' | ') ELSE 'NONE' END AS vt FROM b4)"""


def _span_sql(text: str, ms: str, me: str) -> str:
    after = f"substr({text}, strpos({text}, {q(ms)}) + {len(ms)})"
    before = f"substr({text}, 1, strpos({text}, {q(me)}) - 1)"
    a = f"strpos({text}, {q(ms)}) - 1 + {len(ms)} + (length({after}) - length(ltrim({after}, ' ')))"
    b = f"strpos({text}, {q(me)}) - 1 - (length({before}) - length(rtrim({before}, ' ')))"
    return a, b


def span_marker_sql(mode: str, tables=SER_TABLES) -> str:
    base = profile_sql(tables) + _window_cte(7)
    if mode == "table_context_window_span":
        text = ("('Window Context. Left Columns: ' || lt || '. Target Column Header: <<TARGET_START>> ' || col_name || "
                "' <<TARGET_END>>. Right Columns: ' || rt || '. Target Column Type: ' || y || '. Target Sample Values: ' || vt || '.')")
        a, b = _span_sql("t", "<<TARGET_START>>", "<<TARGET_END>>")
        return base + f", f AS (SELECT table_id, col_name, {text} AS t FROM b5) SELECT table_id, col_name, t AS text, {a} AS span_start, {b} AS span_end FROM f"
    if mode == "table_context_window_span_target_block":
        text = ("('Window Context. Left Columns: ' || lt || '. <<TARGET_BLOCK_START>> Target Column Header: ' || col_name || "
                "'. Target Column Type: ' || y || '. Target Sample Values: ' || vt || '. <<TARGET_BLOCK_END>>. Right Columns: ' || rt || '.')")
        a, b = _span_sql("t", "<<TARGET_BLOCK_START>>", "<<TARGET_BLOCK_END>>")
        return base + f", f AS (SELECT table_id, col_name, {text} AS t FROM b5) SELECT table_id, col_name, t AS text, {a} AS span_start, {b} AS span_end FROM f"
    if mode == "table_context_window_starmie_marker":
        head, blocks = "['Window Table Representation.']", "bm"
    else:
        head, blocks = "['Column Ordered Table Serialization.', 'Each marker denotes one contextualized column representation.']", "bs"
    return base + f" SELECT table_id, col_name, array_to_string(list_concat({head}, list_slice({blocks}, ws + 1, we)), chr(10)) AS text, col_pos - ws AS marker_ordinal FROM b5"


def _extend_oracles_4(o: dict) -> dict:
    for mode in ("table_context_window_span", "table_context_window_span_target_block",
                 "table_context_window_starmie_marker", "table_context_window_starmie_structured"):
        o[f"serialize_{mode}"] = span_marker_sql(mode)
    for mode in ("table_context_window_span", "table_context_window_starmie_marker"):
        o[f"serialize_wide_{mode}"] = span_marker_sql(mode, WIDE_TABLES)
    o["serialize_wide_table_context_window_target_values"] = serialize_sql("table_context_window_target_values", WIDE_TABLES)
    o["span_pool"] = pool_sql("table_context_window_span", True)
    o["marker_pool"] = pool_sql("table_context_window_starmie_structured", False)
    return o


WIDE_TABLES = ["lineitem"]


def pool_sql(mode: str, span: bool) -> str:
    """Tokens split at blanks with (length, letters ``e``, first code); mean over the span, or the target's marker; unit length."""
    if span:
        pick = "t.e > f.span_start AND t.s < f.span_end AND t.s <> t.e"
    else:
        pick = "t.marker AND t.k = f.marker_ordinal"
    return f"""WITH f AS ({span_marker_sql(mode)}),
        w AS (SELECT table_id, col_name, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM f),
        p AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY table_id, col_name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, suffix(w, '<<COL>>') AS marker FROM w),
        t AS (SELECT *, s + length(w) AS e, count(*) FILTER (marker) OVER (PARTITION BY table_id, col_name ORDER BY i) - 1 AS k FROM p),
        m AS (SELECT f.table_id, f.col_name, avg(length(w)) AS a, avg(length(w) - length(replace(w, 'e', ''))) AS b, avg(CASE WHEN w = '' THEN 0 ELSE unicode(w) END) AS c
              FROM f JOIN t ON t.table_id = f.table_id AND t.col_name = f.col_name AND {pick} GROUP BY ALL)
        SELECT table_id, col_name, round(a / sqrt(a * a + b * b + c * c), 6) AS v0, round(b / sqrt(a * a + b * b + c * c), 6) AS v1, round(c / sqrt(a * a + b * b + c * c), 6) AS v2 FROM m"""


def augment_cells_sql() -> str:
    u = lambda *parts: f"(('0x' || substr(md5('42:' || concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"
    return f"""
    WITH c AS (SELECT row_id, col_name, col_pos, value FROM ({cells(['customer'], clean_text=False)})),
    f AS (SELECT {u(q('frac'))} AS u_frac, {u(q('drop'))} AS u_drop, {u(q('blank'))} AS u_blank, {u(q('rate'))} AS u_rate, {u(q('shuffle'))} AS u_shuffle),
    r AS (SELECT DISTINCT row_id FROM c),
    nn AS (SELECT count(*) AS n FROM r),
    k AS (SELECT CASE WHEN n > 12 THEN least(greatest(12, CAST(floor(n * (0.55 + 0.35 * u_frac)) AS BIGINT)), n) ELSE n END AS k FROM nn, f),
    keep AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {u(q('row'), 'CAST(row_id AS VARCHAR)')}, row_id) AS rk FROM r) WHERE rk <= (SELECT k FROM k)),
    dropc AS (SELECT CASE WHEN (SELECT count(DISTINCT col_name) FROM c) > 3 AND (SELECT u_drop FROM f) < 0.6
                 THEN (SELECT col_name FROM (SELECT DISTINCT col_name FROM c) WHERE col_name <> 'c_name' ORDER BY md5('42|dropcol|' || col_name) LIMIT 1) END AS d),
    o AS (SELECT c.* FROM c JOIN keep USING (row_id) WHERE c.col_name IS DISTINCT FROM (SELECT d FROM dropc)),
    b AS (SELECT row_id, col_name,
            CASE WHEN (SELECT u_blank FROM f) < 0.7 AND {u(q('cell'), 'col_name', 'CAST(row_id AS VARCHAR)')} < 0.05 + 0.10 * (SELECT u_rate FROM f) THEN NULL ELSE value END AS value FROM o)
    SELECT CASE WHEN (SELECT u_shuffle FROM f) < 0.35 THEN ('0x' || substr(md5('42|order|' || CAST(row_id AS VARCHAR)), 1, 15))::BIGINT ELSE row_id END AS row_id,
      col_name, value FROM b"""


def _extend_oracles_5(o: dict) -> dict:
    o["augment_cells"] = augment_cells_sql()
    return o


def fuzzy_gt_sql(tables=("customer", "part", "orders")) -> str:
    unit = lambda s: f"(('0x' || substr(md5({s}), 1, 8))::BIGINT / 4294967296.0)"
    parts = []
    for t in tables:
        names = " UNION ALL ".join(f"SELECT {q(c)} AS orig, {i} AS opos" for i, (c, _) in enumerate(SCHEMAS[t]))
        typo = (f"CASE WHEN {unit(chr(39) + '42|hdr|source|' + chr(39) + ' || orig')} < 0.2 THEN "
                f"substr(orig, 1, CAST(floor({unit(chr(39) + '42|hdrpos|source|' + chr(39) + ' || orig')} * length(orig)) AS BIGINT)) || "
                f"substr({q(ALPHA36)}, CAST(floor({unit(chr(39) + '42|hdrchr|source|' + chr(39) + ' || orig')} * 36) AS BIGINT) + 1, 1) || "
                f"substr(orig, CAST(floor({unit(chr(39) + '42|hdrpos|source|' + chr(39) + ' || orig')} * length(orig)) AS BIGINT) + 2) ELSE orig END")
        parts.append(f"""SELECT * FROM (
            WITH n AS ({names}),
            s AS (SELECT orig, opos, row_number() OVER (ORDER BY md5('42|source|' || orig), orig) - 1 AS spos, {typo} AS source_column FROM n),
            tg AS (SELECT orig, 'col_' || CAST(row_number() OVER (ORDER BY md5('42|target|' || orig), orig) AS VARCHAR) AS target_column FROM n),
            f AS (SELECT n.orig, arg_min(s.source_column, s.spos) AS found FROM n JOIN s ON contains(s.source_column, substr(n.orig, 1, 3)) GROUP BY n.orig)
            SELECT n.orig AS original_column, coalesce(f.found, sp.source_column) AS source_column, tg.target_column, {q(t)} AS entity
            FROM n LEFT JOIN f USING (orig) LEFT JOIN s sp ON sp.spos = n.opos JOIN tg USING (orig))""")
    return " UNION ALL ".join(parts)


def _extend_oracles_6(o: dict) -> dict:
    o["fuzzy_ground_truth"] = fuzzy_gt_sql()
    return o


def _extend_oracles_7(o: dict) -> dict:
    o["recall_at_gt"] = f"""WITH {EMB},
        sz AS (SELECT label, count(*) - 1 AS k FROM lab GROUP BY label),
        r AS (SELECT s.src, s.tgt, row_number() OVER (PARTITION BY s.src ORDER BY round(s.score, 12) DESC, s.tgt) AS rn FROM sims s),
        a AS (SELECT l.vec_id AS src, l.label, sz.k FROM lab l JOIN sz USING (label) WHERE sz.k > 0),
        h AS (SELECT a.src, a.k, count(*) FILTER (WHERE r.rn <= a.k AND lt.label = a.label) AS hits
              FROM a JOIN r ON r.src = a.src JOIN lab lt ON lt.vec_id = r.tgt GROUP BY a.src, a.k)
        SELECT round(coalesce(sum(hits) / sum(k), 0.0), 6) AS recall_at_gt FROM h"""
    return o


def _extend_oracles_8(o: dict) -> dict:
    o["lowercase_text"] = "SELECT p_partkey, lower(p_name) AS p_name, lower(p_brand) AS p_brand, lower(p_type) AS p_type, p_size, p_retailprice FROM part"
    o["top_pairs_report"] = f"WITH {EMB} SELECT src AS src_id, tgt AS tgt_id, round(score, 6) AS score FROM sims ORDER BY round(score, 12) DESC, src, tgt LIMIT 30"
    acc = f"SELECT 'accuracy_at_1' AS metric, accuracy AS value FROM ({o['label_topk_accuracy']}) WHERE k = 1"
    rec = f"SELECT 'recall_at_gt' AS metric, recall_at_gt AS value FROM ({o['recall_at_gt']})"
    mrr = f"SELECT 'mrr' AS metric, mrr AS value FROM ({o['embedding_mrr']})"
    o["embedding_eval"] = f"""WITH a AS ({acc}), r AS ({rec}), m AS ({mrr})
        SELECT * FROM a UNION ALL SELECT * FROM r UNION ALL SELECT * FROM m
        UNION ALL SELECT 'selection_score', round(((SELECT value FROM r) + (SELECT value FROM m)) / 2.0, 6)"""
    return o


def murmur3_unit_sql(v: str) -> str:
    """Golden-ratio fraction of the signed 32-bit MurmurHash3 (x86, seed 42) of a text's UTF-8 bytes."""
    low = "4294967295::UBIGINT"
    hexed, size = f"hex(encode({v}))", f"strlen({v})"

    def times(x: str, by: int) -> str:
        return f"(({x} * {by}::UBIGINT) & {low})"

    def turned(x: str, by: int) -> str:
        return f"((({x} << {by}) | ({x} >> {32 - by})) & {low})"

    def word(at: str, n: int) -> str:  # little-endian; bytes past the end are left out
        return "('0x0' || " + " || ".join(f"substr({hexed}, ({at}) + {2 * i + 1}, 2)" for i in reversed(range(n))) + ")::UBIGINT"

    def scrambled(x: str) -> str:
        return f"list_transform([{x}], lambda a: {times('a', 0xCC9E2D51)})[1]"

    def mixed(x: str) -> str:
        return f"list_transform([{scrambled(x)}], lambda b: {times(turned('b', 15), 0x1B873593)})[1]"

    blocks = f"list_transform(range({size} // 4), lambda i: {mixed(word('i * 8', 4))})"
    step = f"list_transform([xor(h, k)], lambda x: ({turned('x', 13)} * 5 + {0xE6546B64}::UBIGINT) & {low})[1]"
    body = f"list_reduce(list_prepend(42::UBIGINT, {blocks}), lambda h, k: {step})"
    last = f"xor(xor({body}, {mixed(word(f'({size} // 4) * 8', 3))}), {size}::UBIGINT)"
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        last = f"list_transform([{last}], lambda x: {times(f'xor(x, x >> {shift})', by)})[1]"
    return f"""list_transform(list_transform([{last}], lambda x: xor(x, x >> 16)::BIGINT), lambda h:
        (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) * CAST('{PHI_FRACTION}' AS DOUBLE)
        - floor((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) * CAST('{PHI_FRACTION}' AS DOUBLE)))[1]"""


#: Round by round, all pairs that are the best left for both their sides; ``one`` has the pairs taken.
GREEDY = """ord AS (SELECT source, target, score, row_number() OVER (ORDER BY score DESC, source, target) AS place FROM preds),
    rounds AS (
      SELECT *, place = min(place) OVER (PARTITION BY source) AND place = min(place) OVER (PARTITION BY target) AS won FROM ord
      UNION ALL
      SELECT source, target, score, place, place = min(place) OVER (PARTITION BY source) AND place = min(place) OVER (PARTITION BY target)
      FROM (SELECT *, bool_or(won) OVER (PARTITION BY source) AS s_gone, bool_or(won) OVER (PARTITION BY target) AS t_gone FROM rounds)
      WHERE NOT s_gone AND NOT t_gone),
    one AS (SELECT source, target, score FROM rounds WHERE won)"""


def _extend_oracles_9(o: dict) -> dict:
    greedy = PG.replace("WITH ", "WITH RECURSIVE ", 1) + f", {GREEDY}"
    o["greedy_one_to_one"] = f"""{greedy}
        SELECT CAST(source AS VARCHAR) AS src_col, CAST(target AS VARCHAR) AS tgt_col, round(score, 6) AS score FROM one"""
    core = o["metrics_core"]
    o["metrics_core_one_to_one"] = greedy + core[len(PG):].replace("score FROM preds", "score FROM one", 1).replace("'all' AS scope", "'one_to_one' AS scope", 1)
    o["sample_priority_murmur3"] = sample_sql("priority_sampling", unit=f"({murmur3_unit_sql('value')})")
    o["resume_worklist"] = """
        WITH t AS (SELECT source, count(*) AS documents, coalesce(sum(n_chars), 0) AS characters,
              ('0x' || substr(md5(source), 1, 8))::BIGINT % 2 = 0 AS done FROM documents WHERE source IS NOT NULL GROUP BY source)
        SELECT 'documents' AS method, source, CAST(done AS INT) AS n_results, CASE WHEN done THEN documents END AS value FROM t
        UNION ALL SELECT 'characters', source, CAST(done AS INT), CASE WHEN done THEN characters END FROM t"""
    o["distinct_ratio_sketch"] = f"""
        SELECT table_id, col_name, n_rows, n_distinct > 0.8 * n_rows AS over FROM ({stats(cells(["customer", "orders", "events", "pages"]))})"""
    return o


def oracles() -> dict:
    """Every SQL oracle, by query name."""
    o = _base_oracles()
    for extend in (_extend_oracles_batch1, _extend_oracles_2, _extend_oracles_3, _extend_oracles_4, _extend_oracles_5, _extend_oracles_6, _extend_oracles_7, _extend_oracles_8, _extend_oracles_9):
        o = extend(o)
    return o
