"""Benchmark pair construction from real tables (GEN-*, PRJ-4..6, FN-36, JOIN-12).

``make_pair(table, spec)`` turns any table into a perturbed
``(source, target, ground_truth)`` triple: both sides are narrow projections
of the same scan (no shuffle). Headers are shuffled by a seeded hash and
optionally replaced by opaque names; text cells get one-character noise with
a seeded probability. The header mapping is schema-sized and computed from
the schema on the driver; all cell work runs in the projection.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_unit
from ..sources.catalog import TEXT, Table, kind_of
from .ordering import global_index

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


@dataclass(frozen=True)
class PairSpec:
    """One benchmark flavour. ``None`` prefixes keep the original header."""

    name: str
    src_prefix: str | None = "s"
    tgt_prefix: str | None = "t"
    src_noise: float = 0.04
    tgt_noise: float = 0.04
    min_len: int = 4
    seed: int = 42
    shuffle: bool = True
    header_noise: float = 0.0  # probability of a one-character typo in a source header


# Six flavours after the published generators: same-name, generic/noisy, opaque x4.
SPECS = {
    "v1": PairSpec("v1", None, None, 0.05, 0.0, 5),
    "v2": PairSpec("v2", None, "col_", 0.08, 0.0, 4, header_noise=0.2),
    "v3": PairSpec("v3", "c", "t", 0.04, 0.04, 4),
    "v4": PairSpec("v4", None, None, 0.05, 0.05, 4),
    "v5": PairSpec("v5", "s", "t", 0.04, 0.04, 4),
    "v6": PairSpec("v6", "s", "t", 0.035, 0.035, 4),
}


def _h(seed: int, *parts) -> str:
    return hashlib.md5(("|".join([str(seed), *map(str, parts)])).encode()).hexdigest()


def _unit(seed: int, *parts) -> float:
    return int(_h(seed, *parts)[:8], 16) / 4294967296.0


def header_typo(name: str, p: float, seed: int, side: str) -> str:
    """With probability ``p`` replace one character of a header (schema-sized, computed on the driver)."""
    if p <= 0 or not name or _unit(seed, "hdr", side, name) >= p:
        return name
    pos = int(_unit(seed, "hdrpos", side, name) * len(name))
    ch = ALPHABET[int(_unit(seed, "hdrchr", side, name) * len(ALPHABET))]
    return name[:pos] + ch + name[pos + 1:]


def header_plan(names: list[str], side: str, prefix: str | None, seed: int, shuffle: bool, typo_p: float = 0.0) -> list[tuple[str, str]]:
    """``[(original, new)]`` in output column order (PRJ-4, PRJ-5)."""
    order = sorted(names, key=lambda n: (_h(seed, side, n), n)) if shuffle else list(names)
    return [(n, f"{prefix}{i + 1}" if prefix else header_typo(n, typo_p, seed, side)) for i, n in enumerate(order)]


def noisy_text(v: Column, p: float, seed: int, key: Column, min_len: int) -> Column:
    """With probability ``p`` replace one character of a text of length >= ``min_len`` (FN-36)."""
    u = seeded_unit(F.concat_ws("|", F.lit("p"), key), seed)
    u_pos = seeded_unit(F.concat_ws("|", F.lit("pos"), key), seed)
    u_chr = seeded_unit(F.concat_ws("|", F.lit("chr"), key), seed)
    pos = (F.floor(u_pos * F.length(v)) + 1).cast("int")
    ch = F.substring(F.lit(ALPHABET), (F.floor(u_chr * len(ALPHABET)) + 1).cast("int"), 1)
    changed = F.concat(F.call_function("substr", v, F.lit(1), pos - 1), ch, F.call_function("substr", v, pos + 1))
    return F.when(v.isNotNull() & (F.length(v) >= min_len) & (u < p), changed).otherwise(v)


def _side(t: Table, side: str, prefix: str | None, p: float, spec: PairSpec) -> tuple[DataFrame, list[tuple[str, str]]]:
    fields = {f.name: f.dataType for f in t.df.schema.fields}
    plan = header_plan(list(fields), side, prefix, spec.seed, spec.shuffle, spec.header_noise if side == "source" else 0.0)
    rid = t.row_id().cast("string")
    cols = []
    for orig, new in plan:
        c = F.col(f"`{orig}`")
        if kind_of(fields[orig]) == TEXT and p > 0:
            key = F.concat_ws("|", F.lit(side), F.lit(orig), rid)
            c = noisy_text(c.cast("string"), p, spec.seed, key, spec.min_len)
        cols.append(c.alias(new))
    return t.df.select(t.row_id().alias("row_id"), *cols), plan


def make_pair(t: Table, spec: PairSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(source, target, ground_truth)``; ground truth rows ``(source_column, target_column, entity, role, pair_id)`` (JOIN-12)."""
    src, splan = _side(t, "source", spec.src_prefix, spec.src_noise, spec)
    tgt, tplan = _side(t, "target", spec.tgt_prefix, spec.tgt_noise, spec)
    s_map = dict(splan)
    t_map = dict(tplan)
    gt_rows = [(s_map[o], t_map[o], t.table_id, o, t.table_id) for o, _ in splan]
    gt = src.sparkSession.createDataFrame(gt_rows, "source_column string, target_column string, entity string, role string, pair_id string")
    return src, tgt, gt


def block_order(tables: list[Table], side: str, seed: int) -> list[Table]:
    """Entity blocks of a side: as given on the source side, by seeded hash on the target side."""
    return list(tables) if side == "source" else sorted(tables, key=lambda t: (_h(seed, "block", t.table_id), t.table_id))


def _block_side(tables: list[Table], side: str, prefix: str | None, p: float, spec: PairSpec) -> tuple[DataFrame, list[tuple]]:
    """Blocks side by side, row by row in key order, and ``(entity, role, header)`` of every column."""
    out, heads = None, []
    for i, t in enumerate(block_order(tables, side, spec.seed), start=1):
        if t.order_key is None:
            raise ValueError(f"no order key: {t.table_id}")
        keyed = t.df.withColumn("_rid", t.row_id())
        placed = global_index(keyed, [F.col("_rid")], "row_id")
        cols = []
        for j, f in enumerate(t.df.schema.fields, start=1):
            c, new = F.col(f"`{f.name}`"), f"{prefix}{i}_{j}" if prefix else f.name
            if kind_of(f.dataType) == TEXT and p > 0:
                key = F.concat_ws("|", F.lit(side), F.lit(f.name), F.col("_rid").cast("string"))
                c = noisy_text(c.cast("string"), p, spec.seed, key, spec.min_len)
            cols.append(c.alias(new))
            heads.append((t.table_id, f.name, new))
        block = placed.select("row_id", *cols)
        out = block if out is None else out.join(block, "row_id", "full_outer")
    return out, heads


def make_block_pair(tables: list[Table], spec: PairSpec, anchors: dict[str, set[str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(source, target, ground_truth)`` of several entity blocks side by side (GEN-1, GEN-3..6).

    Each side has its own block order and, with a prefix, opaque headers
    ``prefix{block}_{column}``. Rows of the blocks line up by their place in key
    order; a block with fewer rows is padded with nulls. ``anchors`` (entity ->
    columns) stay in both tables but out of the truth, which pairs the same role
    of the same entity.
    """
    anchors = anchors or {}
    src, s_heads = _block_side(tables, "source", spec.src_prefix, spec.src_noise, spec)
    tgt, t_heads = _block_side(tables, "target", spec.tgt_prefix, spec.tgt_noise, spec)
    target = {(e, r): h for e, r, h in t_heads}
    rows = [(e, r, h, target[e, r]) for e, r, h in s_heads if r not in anchors.get(e, ())]
    return src, tgt, src.sparkSession.createDataFrame(rows, "entity string, role string, source_column string, target_column string")


def fuzzy_ground_truth(src_headers: DataFrame, originals: DataFrame) -> DataFrame:
    """Ground truth by header resemblance (JOIN-13).

    ``src_headers``: ``(spos, source_column)`` in source order; ``originals``:
    ``(opos, original_column, base, target_column)``. The match is the first
    source header containing the first three characters of ``base`` (which
    also covers "contains ``base``"), else the source header at the original's
    position. Candidates come from an equi-join of the stem with the headers'
    own n-grams (exact blocking, no theta join).
    """
    from pyspark.sql import Window

    grams = None
    for n in (1, 2, 3):
        g = src_headers.select("spos", "source_column", F.explode(F.regexp_extract_all("source_column", F.lit(f"(?s)(?=(.{{{n}}}))"), 1)).alias("gram"))
        grams = g if grams is None else grams.unionByName(g)
    grams = grams.distinct()
    o = originals.withColumn("stem", F.substring("base", 1, 3))
    cand = o.join(grams, o["stem"] == grams["gram"]).select("opos", "original_column", "spos", "source_column")
    w = Window.partitionBy("original_column").orderBy("spos")
    first = cand.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("original_column", F.col("source_column").alias("_found"))
    positional = src_headers.select(F.col("spos").alias("opos"), F.col("source_column").alias("_pos_col"))
    j = o.join(first, "original_column", "left").join(positional, "opos", "left")
    return j.select("original_column", F.coalesce("_found", "_pos_col").alias("source_column"), "target_column")


def pair_cells(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Long form of both sides: ``(side, row_id, col_name, value)``."""
    def long(df, side):
        names = [c for c in df.columns if c != "row_id"]
        w = df.select("row_id", *[F.col(f"`{n}`").cast("string").alias(n) for n in names])
        return w.unpivot(["row_id"], names, "col_name", "value").withColumn("side", F.lit(side))

    return long(src, "source").unionByName(long(tgt, "target")).select("side", "row_id", "col_name", "value")


def concat_blocks(tables: list[Table]) -> DataFrame:
    """Horizontal block concat (PRJ-6) of tables sharing a row key: equi-join on ``row_id``.

    Every table needs an order key: scan positions depend on how a table is split.
    """
    if missing := [t.table_id for t in tables if t.order_key is None]:
        raise ValueError(f"no order key: {', '.join(missing)}")
    out = None
    for t in tables:
        d = t.df.select(t.row_id().alias("row_id"), *[F.col(f"`{c}`") for c in t.df.columns])
        out = d if out is None else out.join(d, "row_id", "full_outer")
    return out


def augment_cells(cells_df: DataFrame, target_col: str, seed: int = 42) -> DataFrame:
    """Row sub-sample, one column drop, cell blanking and row shuffle of one table in cell form (WIN-12).

    ``cells_df``: ``(row_id, col_name, col_pos, value)`` of one table. Every draw is a
    seeded hash. The row sample keeps exactly ``k`` rows with the smallest row
    hashes: hashes are uniform, so fixed-width hash buckets hold bounded row
    counts; the bucket of the k-th row is found from bucket totals and only
    inside buckets are rows ranked.
    """
    from pyspark.sql import Window

    u = lambda *p: seeded_unit(F.concat_ws("|", *[x if isinstance(x, Column) else F.lit(str(x)) for x in p]), seed)
    rows = cells_df.select("row_id").distinct().withColumn("_h", u("row", F.col("row_id")))
    n = rows.count()
    spark = cells_df.sparkSession
    flags = spark.range(1).select(
        u("frac").alias("u_frac"), u("drop").alias("u_drop"), u("blank").alias("u_blank"),
        u("rate").alias("u_rate"), u("shuffle").alias("u_shuffle"),
    ).first()
    k = n
    if n > 12:
        k = min(max(12, int(n * (0.55 + 0.35 * flags["u_frac"]))), n)
    buckets = max(1, n // 100_000)
    rows = rows.withColumn("_b", F.least(F.floor(F.col("_h") * buckets), F.lit(buckets - 1)))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_bn"))
    wb = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over bucket totals only
    counts = counts.withColumn("_off", F.coalesce(F.sum("_bn").over(wb), F.lit(0)))
    wi = Window.partitionBy("_b").orderBy("_h", "row_id")
    ranked = rows.join(counts, "_b").withColumn("_r", F.col("_off") + F.row_number().over(wi))
    keep = ranked.filter(F.col("_r") <= k).select("row_id")
    out = cells_df.join(keep, "row_id", "left_semi")
    cols = cells_df.select("col_name", "col_pos").distinct().collect()  # schema-sized
    if len(cols) > 3 and flags["u_drop"] < 0.6:
        cand = sorted((c["col_name"] for c in cols if c["col_name"] != target_col),
                      key=lambda c: hashlib.md5(f"{seed}|dropcol|{c}".encode()).hexdigest())
        out = out.filter(F.col("col_name") != cand[0])
    if flags["u_blank"] < 0.7:
        rate = 0.05 + 0.10 * flags["u_rate"]
        out = out.withColumn("value", F.when(u("cell", F.col("col_name"), F.col("row_id")) < rate, F.lit(None).cast("string")).otherwise(F.col("value")))
    if flags["u_shuffle"] < 0.35:
        out = out.withColumn("row_id", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|order"), F.col("row_id").cast("string"))), 1, 15), 16, 10).cast("long"))
    return out
