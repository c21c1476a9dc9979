"""Column-to-text serialisation (FN-13..23, PRJ-7, FLT-4).

Input: a column profile ``(table_id, col_name, col_pos, semantic_type, samples)``.
Each mode is one projection of ``concat`` / ``array_join`` expressions; the
table-context modes join each column to the ordered header list of its table
(one small ``collect_list`` per table, bounded by the table's width) and cut
the context window in closed form from ``(position, width, window)``.

Token defaults ``<s>`` / ``</s>`` / ``</s>`` are the classification, separator
and end tokens of the default sentence encoder; pass others through options.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMPLE_MODES = (
    "header_values_default",
    "header_values_prefix",
    "header_values_repeat",
    "header_values_verbose",
    "header_only",
    "header_values_verbose_notype",
    "header_values_columnvaluepair_notype",
    "header_header_values_repeat_notype",
    "header_values_default_notype",
)
CONTEXT_MODES = ("table_context_target_values", "table_context_window_target_values")
SPAN_MODES = ("table_context_window_span", "table_context_window_span_target_block")
MARKER_MODES = ("table_context_window_starmie_marker", "table_context_window_starmie_structured")


@dataclass(frozen=True)
class Tokens:
    cls: str = "<s>"
    sep: str = "</s>"
    eos: str = "</s>"
    marker_start: str = "<TARGET>"
    marker_end: str = "</TARGET>"
    span_start: str = "<<TARGET_START>>"
    span_end: str = "<<TARGET_END>>"
    block_start: str = "<<TARGET_BLOCK_START>>"
    block_end: str = "<<TARGET_BLOCK_END>>"
    col_marker: str = "<<COL>>"


def _lit(s: str) -> Column:
    return F.lit(s)


def simple_text(mode: str, tok: Tokens = Tokens(), strict_notype: bool = False) -> Column:
    """Text of one column for the nine simple modes (columns ``col_name, semantic_type, samples``)."""
    h, y, v = F.col("col_name"), F.col("semantic_type"), F.coalesce(F.col("samples"), F.array().cast("array<string>"))
    C, S, E = _lit(tok.cls), _lit(tok.sep), _lit(tok.eos)
    joined = F.array_join(v, tok.sep)
    if mode == "header_values_verbose":
        return F.concat(C, _lit("Column: "), h, S, _lit("Type: "), y, S, _lit("Values: "), joined, S)
    if mode == "header_values_default" or (mode == "header_values_default_notype" and not strict_notype):
        # the notype name dispatches to the typed body (kept as the reference behaves)
        return F.concat(C, h, S, y, S, joined)
    if mode == "header_values_default_notype":
        return F.concat(C, h, S, joined)
    if mode == "header_values_prefix":
        return F.concat(C, _lit("header:"), h, S, _lit("datatype:"), y, S, _lit("values:"), F.array_join(v, ", "))
    if mode in ("header_values_repeat", "header_header_values_repeat_notype"):
        return F.concat(C, F.array_join(F.array_repeat(h, 5), tok.sep), S, y, S, joined)
    if mode == "header_only":
        return F.concat(C, h, E)
    if mode == "header_values_verbose_notype":
        return F.concat(C, _lit("Column: "), h, S, _lit("Values: "), joined, S, E)
    if mode == "header_values_columnvaluepair_notype":
        pairs = F.transform(v, lambda x: F.concat(h, _lit(":"), x))
        return F.concat(C, _lit("Column: "), h, S, _lit("Values: "), F.array_join(pairs, tok.sep), S, E)
    raise ValueError(f"unsupported encoding mode {mode!r}")


def window_bounds(pos: Column, n: Column, w: int | None) -> tuple[Column, Column]:
    """``[start, end)`` of the ``w``-column window around ``pos`` in a table of ``n`` columns.

    Odd slot goes right; slack at an edge moves to the other side; ``None``
    or ``w >= n`` keeps all columns; ``w <= 1`` keeps the target only.
    """
    if w is None:
        return F.lit(0), n
    if w <= 1:
        return pos, pos + 1
    left = (w - 1) // 2
    right = w - 1 - left
    start = F.greatest(F.lit(0), pos - left)
    end = F.least(n, pos + right + 1)
    missing = F.lit(w) - (end - start)
    new_start = F.greatest(F.lit(0), start - missing)
    missing2 = missing - (start - new_start)
    new_end = F.least(n, end + missing2)
    fits = F.lit(w) >= n
    return (
        F.when(fits, F.lit(0)).when(missing > 0, new_start).otherwise(start),
        F.when(fits, n).when(missing > 0, new_end).otherwise(end),
    )


def _clean_tokens(v: Column) -> Column:
    stripped = F.transform(v, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda x: x.isNotNull() & (x != ""))


def _join_non_empty(parts: list[Column], tok: Tokens) -> Column:
    """Join stripped non-empty parts with `` [SEP] `` and glue cls/eos with one space."""
    stripped = F.filter(
        F.array(*[F.regexp_replace(p, r"(?U)^\s+|\s+$", "") for p in parts]), lambda x: x.isNotNull() & (x != "")
    )
    text = F.array_join(stripped, " [SEP] ")
    if tok.cls:
        text = F.replace(text, _lit(f"{tok.cls} [SEP] "), _lit(f"{tok.cls} "))
    if tok.eos:
        text = F.replace(text, _lit(f" [SEP] {tok.eos}"), _lit(f" {tok.eos}"))
    return text


def _target_block(tok: Tokens, repeat_header: bool, include_type: bool = True, include_values: bool = True) -> Column:
    h = F.col("col_name")
    parts = [F.concat(_lit("Target Column Name: "), h)]
    if repeat_header:
        parts.append(F.concat(_lit("Target Column Focus: "), h))
    if include_type:
        parts.append(F.concat(_lit("Target Column Type: "), F.col("semantic_type")))
    if include_values:
        toks = _clean_tokens(F.coalesce(F.col("samples"), F.array().cast("array<string>")))
        parts.append(
            F.concat(_lit("Target Sample Values: "), F.when(F.size(toks) > 0, F.array_join(toks, " | ")).otherwise(_lit("NONE")))
        )
    return _join_non_empty(parts, tok)


def with_table_headers(profile: DataFrame) -> DataFrame:
    """Attach ``headers`` (ordered names of the column's table) and ``n_cols``."""
    heads = profile.groupBy("table_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_pos", "col_name"))), lambda s: s["col_name"]).alias("headers")
    )
    return profile.join(heads, "table_id").withColumn("n_cols", F.size("headers"))


def context_text(mode: str, tok: Tokens = Tokens(), window: int | None = 7) -> Column:
    """Text for the two table-context modes; needs ``headers``, ``n_cols``, ``col_pos``."""
    h = F.col("col_name")
    marked = F.concat(_lit(tok.marker_start + " "), h, _lit(" " + tok.marker_end))
    if mode == "table_context_target_values":
        listed = F.transform(F.col("headers"), lambda x, i: F.when(i == F.col("col_pos"), marked).otherwise(x))
        schema_block = F.concat(_lit("Table Columns: "), F.array_join(listed, " | "))
        return _join_non_empty(
            [_lit(tok.cls), _lit("Contextual Column Representation"), schema_block, _target_block(tok, False), _lit(tok.eos)], tok
        )
    if mode == "table_context_window_target_values":
        start, end = window_bounds(F.col("col_pos"), F.col("n_cols"), window if window is not None else 7)
        left = F.slice(F.col("headers"), start + 1, F.col("col_pos") - start)
        right = F.slice(F.col("headers"), F.col("col_pos") + 2, F.greatest(end - F.col("col_pos") - 1, F.lit(0)))
        left_t = F.when(F.size(left) > 0, F.array_join(left, " | ")).otherwise(_lit("NONE"))
        right_t = F.when(F.size(right) > 0, F.array_join(right, " | ")).otherwise(_lit("NONE"))
        block = F.concat(
            _lit("Left Context Columns: "), left_t, _lit(". Target Marker: "), marked, _lit(". Right Context Columns: "), right_t, _lit(".")
        )
        return _join_non_empty(
            [_lit(tok.cls), _lit("Windowed Contextual Column Representation"), block, _target_block(tok, True), _lit(tok.eos)], tok
        )
    raise ValueError(f"unsupported context mode {mode!r}")


def _window_lists(window: int | None):
    start, end = window_bounds(F.col("col_pos"), F.col("n_cols"), window)
    left = F.slice(F.col("headers"), start + 1, F.col("col_pos") - start)
    right = F.slice(F.col("headers"), F.col("col_pos") + 2, F.greatest(end - F.col("col_pos") - 1, F.lit(0)))
    none = lambda a: F.when(F.size(a) > 0, F.array_join(a, " | ")).otherwise(_lit("NONE"))
    return start, end, none(left), none(right)


def _values_text(sep: str) -> Column:
    toks = _clean_tokens(F.coalesce(F.col("samples"), F.array().cast("array<string>")))
    return F.when(F.size(toks) > 0, F.array_join(toks, sep)).otherwise(_lit("NONE"))


def _span(text: Column, m_start: str, m_end: str) -> tuple[Column, Column]:
    """Character span between two markers, surrounding spaces excluded (0-based, end exclusive)."""
    s_idx = F.locate(m_start, text) - 1
    e_idx = F.locate(m_end, text) - 1
    after = F.call_function("substr", text, s_idx + len(m_start) + 1)
    lead = F.length(F.regexp_extract(after, "^ *", 0))
    before = F.call_function("substr", text, F.lit(1), e_idx)
    trail = F.length(F.regexp_extract(before, " *$", 0))
    return s_idx + len(m_start) + lead, e_idx - trail


def span_text(mode: str, tok: Tokens = Tokens(), window: int | None = 7) -> tuple[Column, Column, Column]:
    """Text and target span for the two span modes (FN-24, FN-25)."""
    _, _, left, right = _window_lists(window)
    h, y = F.col("col_name"), F.col("semantic_type")
    if mode == "table_context_window_span":
        text = F.concat(
            _lit("Window Context. Left Columns: "), left, _lit(". Target Column Header: "),
            _lit(tok.span_start + " "), h, _lit(" " + tok.span_end), _lit(". Right Columns: "), right,
            _lit(". Target Column Type: "), y, _lit(". Target Sample Values: "), _values_text(" | "), _lit("."),
        )
        a, b = _span(text, tok.span_start, tok.span_end)
    else:
        block = F.concat(_lit("Target Column Header: "), h, _lit(". Target Column Type: "), y,
                         _lit(". Target Sample Values: "), _values_text(" | "), _lit("."))
        text = F.concat(
            _lit("Window Context. Left Columns: "), left, _lit(". "), _lit(tok.block_start + " "), block,
            _lit(" " + tok.block_end + ". Right Columns: "), right, _lit("."),
        )
        a, b = _span(text, tok.block_start, tok.block_end)
    return text, a, b


def _column_block(mode: str, tok: Tokens) -> Column:
    h = F.col("col_name")
    if mode == "table_context_window_starmie_marker":
        toks = _clean_tokens(F.coalesce(F.col("samples"), F.array().cast("array<string>")))
        return F.array_join(F.concat(F.array(_lit(tok.col_marker), h), toks), " | ")
    return F.concat(_lit(tok.col_marker + " ; header = "), h, _lit(" ; type = "), F.col("semantic_type"),
                    _lit(" ; values = "), _values_text(" ; "))


def marker_texts(profile: DataFrame, mode: str, tok: Tokens = Tokens(), window: int | None = 7) -> DataFrame:
    """Window of column blocks with one marker per column, plus the target's ordinal (FN-26, FN-27).

    Each column's block is built once; a table's blocks are collected in
    position order (schema-sized) and every column slices its window.
    """
    blocks = profile.withColumn("_blk", _column_block(mode, tok))
    per_table = blocks.groupBy("table_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_pos", "_blk"))), lambda x: x["_blk"]).alias("_blocks")
    )
    j = profile.join(per_table, "table_id").withColumn("n_cols", F.size("_blocks"))
    start, end = window_bounds(F.col("col_pos"), F.col("n_cols"), window)
    win = F.slice(F.col("_blocks"), start + 1, end - start)
    head = ["Window Table Representation."] if mode == "table_context_window_starmie_marker" else [
        "Column Ordered Table Serialization.", "Each marker denotes one contextualized column representation."]
    text = F.array_join(F.concat(F.array(*[_lit(x) for x in head]), win), "\n")
    return j.select(*profile.columns, text.alias("text"), (F.col("col_pos") - start).alias("marker_ordinal")).drop("_blocks")


def serialize(profile: DataFrame, mode: str, tok: Tokens = Tokens(), window: int | None = 7) -> DataFrame:
    """``profile`` + ``text`` (+ ``span_start``/``span_end`` or ``marker_ordinal``) for any supported mode."""
    if mode in SIMPLE_MODES:
        return profile.withColumn("text", simple_text(mode, tok))
    if mode in CONTEXT_MODES:
        return with_table_headers(profile).withColumn("text", context_text(mode, tok, window)).drop("headers", "n_cols")
    if mode in SPAN_MODES:
        p = with_table_headers(profile)
        text, a, b = span_text(mode, tok, window)
        return p.withColumn("text", text).withColumn("span_start", a).withColumn("span_end", b).drop("headers", "n_cols")
    if mode in MARKER_MODES:
        return marker_texts(profile, mode, tok, window)
    raise ValueError(f"unsupported encoding mode {mode!r}; use one of {SIMPLE_MODES + CONTEXT_MODES + SPAN_MODES + MARKER_MODES}")
