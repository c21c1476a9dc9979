"""Removal of lines that many sites share (built-in functions only).

Every line is known by a 128-bit hash. The sites it appears on are counted by
HyperLogLog sketches that merge by aggregation, so a line on a third of all
documents costs one small sketch per task. Estimates clear of the threshold
decide at once; lines near it get an exact distinct count. A line found on
``min_sites`` sites or more is boilerplate (a long one, which hardly repeats by
chance, on ``long_sites`` or more): it stays in the first document that
has it (the smallest id) and is removed from all others, so no text is lost
altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.llm.common import store

#: Sites that make a line boilerplate. On sf0.1 lines lie on 4 sites or fewer (copies of whole
#: documents) or on 6 or more; none lies on 5.
MIN_SITES = 5
#: The same for lines of LONG_WORDS words or more, which hardly repeat by chance.
LONG_SITES, LONG_WORDS = 5, 50
#: Shorter lines (without outer blanks) are never boilerplate: only blank ones are.
MIN_CHARS = 1
#: Sketch size (2^12 registers: 1.6 % standard error) and the share of the
#: threshold around it, 15 such errors, within which lines are counted exactly.
LG_K = 12
NEAR = 0.25


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame, site_col: str = "source", id_col: str = "doc_id", text_col: str = "text",
              min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, th (hash of the text), site, pos, h1, h2, long: every line that is long enough and not white space alone."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(site_col).cast("string").alias("site"),
                       F.posexplode(_lines(text)).alias("pos", "line")).withColumn("line", F.trim("line"))
    blank = F.trim(F.translate("line", "\t\r\f\v", "    ")) == ""
    return rows.filter((F.char_length("line") >= min_chars) & ~blank).select(
        "doc_id", "th", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        ((F.char_length("line") >= 2 * LONG_WORDS - 1) & (F.size(F.split("line", r"\s+")) >= LONG_WORDS)).alias("long"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, long_sites: int = LONG_SITES) -> DataFrame:
    """h1, h2, home: the lines on ``min_sites`` sites or more and the first document of each.

    Long lines are taken from ``long_sites`` on, if that is less.

    ``lines`` is read twice and should be a stored table. A null site counts
    as no site.
    """
    least = F.when(F.col("long"), min(long_sites, min_sites)).otherwise(min_sites)
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("doc_id", "th")).alias("home"), F.max("long").alias("long"))
    wide = store(
        spread.select("h1", "h2", "home", F.hll_sketch_estimate("sketch").alias("sites"), least.alias("least"))
        .filter(F.col("sites") >= F.col("least") * (1 - NEAR)), "wide-lines")
    near = wide.filter(F.col("sites") <= F.col("least") * (1 + NEAR))
    exact = (
        lines.select("h1", "h2", "site", least.alias("least")).join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").distinct()
        .groupBy("h1", "h2", "least").agg(F.count("site").alias("exact")).filter(F.col("exact") >= F.col("least"))
    )
    sure = wide.filter(F.col("sites") > F.col("least") * (1 + NEAR)).select("h1", "h2", "home")
    return sure.unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"]).select("h1", "h2", "home"))


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", id_col: str = "doc_id",
                        text_col: str = "text", min_chars: int = MIN_CHARS, clash: str = "__", long_sites: int = LONG_SITES) -> DataFrame:
    """Every row of ``docs`` with its text cleared of boilerplate lines, n_lines and n_removed.

    Both counts replace columns of these names. Null text stays null and has
    no lines; an empty text has one, empty. Rows alike in id and text are
    treated alike. Line breaks are ``\\n``; a line is compared without outer
    blanks.
    """
    lines = store(line_rows(docs, site_col, id_col, text_col, min_chars), "lines")
    known = store(boilerplate(lines, min_sites, long_sites), "boilerplate")
    gone = (
        lines.drop("site", "long").join(known, ["h1", "h2"])
        .filter(~F.struct("doc_id", "th").eqNullSafe(F.col("home")))
        .groupBy("doc_id", "th").agg(F.collect_set("pos").alias(f"{clash}gone"))
        .select(F.col("doc_id").alias(f"{clash}d"), F.col("th").alias(f"{clash}t"), f"{clash}gone")
    )
    docs = docs.drop("n_lines", "n_removed")
    text = F.col(text_col).cast("string")
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone[f"{clash}d"]) & (F.xxhash64(docs[text_col].cast("string")) == gone[f"{clash}t"]), "left")
    all_lines, n_gone = _lines(text), F.coalesce(F.size(f"{clash}gone"), F.lit(0))
    split = joined.withColumn(f"{clash}lines", F.when(n_gone > 0, all_lines))
    n = F.size(f"{clash}lines")
    keep = F.array_except(F.sequence(F.lit(0), n - 1), F.col(f"{clash}gone"))
    kept = F.transform(keep, lambda i: F.get(F.col(f"{clash}lines"), i))
    return split.select(
        *[(F.when(n_gone > 0, F.array_join(kept, "\n")).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(all_lines)).cast("long").alias("n_lines"),
        F.when(F.col(f"{clash}gone").isNull(), 0).otherwise(F.size(f"{clash}gone")).cast("long").alias("n_removed"))
