"""Value counts keyed by digests, with texts fetched only for the values that are chosen (AGG-1).

A value of at most ``SHORT`` bytes is its own key, a longer one is known by its
128-bit digest in hex: the counting shuffle carries nothing wider, whatever the cells
hold. What statistics and samplers ask of a long text (is it a number, a date;
its first characters; its random draw) is worked out where the cell is read.
``with_text`` fetches texts by row and checks their digest, so a table of long
documents sends to a shuffle only those that a sample shows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import clean_text, is_binary_word, is_date_text, is_integer_text, is_number_text, strip_unicode
from ..functions.hashing import TWO_32, md5_unit, seeded_unit
from ..session import cut_lineage
from ..sources.catalog import TEXT, Table, cells as cells_of, native_counts
from .sampling import KEYS, MODES, evenly_spread, natural_sort_key

#: Bytes of a value that is its own key, and characters of a longer one that order it.
SHORT, HEAD = 32, 16
_NUMBER, _INTEGER = 1, 2
#: Hash slots whose least keys bound a sample.
SLOTS = 64
#: Sampling modes that need the draws of a seed.
DRAWN = ("random", "weighted")
ID = [*KEYS, "short", "digest"]


def _keyed(df: DataFrame, seed: int | None) -> DataFrame:
    """Replace ``value`` by its key; for long values also ``marks``, ``head`` and, with a seed, ``draw``."""
    v = F.col("value")
    long = F.octet_length(v) > SHORT
    number = F.when(is_number_text(v), F.when(is_integer_text(v), _NUMBER + _INTEGER).otherwise(_NUMBER)).otherwise(0)
    # numbers begin with a sign, digit, point or the i of infinity: other texts are looked at no further
    marks = F.when(F.substring(v, 1, 1).rlike(r"[\s+\-.0-9iI]"), number).otherwise(0)
    # the layouts of dates are shorter than SHORT, so a long value is one only with blanks around it
    bare = strip_unicode(v)
    padded = F.when(long & v.rlike(r"^\s*\d") & (F.octet_length(bare) <= SHORT), bare)
    return df.select(
        *[c for c in df.columns if c != "value"],
        F.when(~long, v).alias("short"),
        F.when(long, F.md5(v)).alias("digest"),
        F.when(long & (F.col("kind") == TEXT), marks).alias("marks"),
        F.when(long, F.substring(v, 1, HEAD)).alias("head"),
        padded.alias("padded"),
        (F.lit(None).cast("double") if seed is None else F.when(long, seeded_unit(v, seed))).alias("draw"),
    )


def _long_text(clean: bool) -> Column:
    return F.lit(clean) & (F.col("kind") == TEXT) & (F.octet_length("value") > SHORT)


def _cell_digests(cells: DataFrame, clean: bool, seed: int | None) -> DataFrame:
    """Counts of cells by key; short texts are not cleaned yet (``done``)."""
    long = F.coalesce(_long_text(clean), F.lit(False))
    read = cells.select(*KEYS, "row_id", long.alias("done"), F.when(long, clean_text("value")).otherwise(F.col("value")).alias("value"))
    # a long value's marks, head and draw are functions of it: any of the group's rows has them. The head, a
    # text, is a key: as the maximum of texts it would make Spark sort all cells instead of hashing them
    return _keyed(read, seed).groupBy(*ID, "head", "padded", "done").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("row_id").alias("first_row"), *[F.max(c).alias(c) for c in ("marks", "draw")])


def value_digests(cells: DataFrame | None, clean: bool = False, seed: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``(table_id, col_name, col_pos, kind, short, digest, head, padded, marks, draw, cnt, first_row)``, nulls as a value.

    With ``clean`` the cells are raw. Long texts are cleaned where they are
    read, as few of them repeat; short ones are counted first and cleaned once
    for each different value. Both key columns are null for the null value.
    ``draw`` is null without a seed; ``random`` and ``weighted`` samples need one.
    ``counted`` are cells with counts, see ``native_counts``; either input may be None.
    """
    found = ["marks", "draw"]
    parts = [] if cells is None else [_cell_digests(cells, clean, seed)]
    if counted is not None:
        held = counted.select(*KEYS, "cnt", F.col("row_id").alias("first_row"), F.lit(False).alias("done"), "value")
        parts.append(_keyed(held, seed))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if not clean:
        if counted is None:
            return counts.drop("done")
        return counts.groupBy(*ID, "head", "padded").agg(F.sum("cnt").alias("cnt"), F.min("first_row").alias("first_row"), *[F.max(c).alias(c) for c in found])
    # one path for all rows, as each branch of a union would scan the tables again
    again = (F.col("kind") == TEXT) & ~F.col("done") & F.col("short").isNotNull()
    cleaned = _keyed(counts.withColumn("value", F.when(again, clean_text("short")).otherwise(F.col("short"))).withColumnsRenamed(
        {c: f"_{c}" for c in ["short", "digest", "head", "padded", *found]}), seed)
    kept = [F.coalesce(f"_{c}", c).alias(c) for c in ["digest", "head", "padded", *found]]
    return cleaned.select(*KEYS, "short", *kept, "cnt", "first_row").groupBy(*ID, "head", "padded").agg(
        F.sum("cnt").alias("cnt"), F.min("first_row").alias("first_row"), *[F.max(c).alias(c) for c in found])


def table_digests(tables: list[Table], clean: bool = False, seed: int | None = None) -> DataFrame:
    """``value_digests`` of the raw cells of tables, columns that are not text counted before they are made text."""
    return value_digests(cells_of(tables, clean=False, native=False), clean, seed, native_counts(tables))


def is_value(df: DataFrame) -> Column:
    """Whether a row of value digests stands for a value, not for null."""
    return F.col("short").isNotNull() | F.col("digest").isNotNull()


def _mark(bit: int, short_test: Column) -> Column:
    return F.when(F.col("digest").isNotNull(), F.col("marks").bitwiseAND(bit) > 0).otherwise(short_test)


def stats_inputs(vd: DataFrame) -> dict[str, Column]:
    """What ``profile.column_stats`` asks of a value, by the key or by the marks of a long one."""
    s = F.col("short")
    return {
        "nonnull": is_value(vd),
        "number": _mark(_NUMBER, is_number_text(s)),
        "integer": _mark(_INTEGER, is_integer_text(s)),
        "date": is_date_text(F.coalesce(s, "padded")),
        "binary": F.coalesce(is_binary_word(s), F.lit(False)),
    }


def with_text(vd: DataFrame, cells: DataFrame, clean: bool = False, by_row: bool = True) -> DataFrame:
    """``vd`` with ``value``: the key of short values, the text of long ones, fetched from ``cells``.

    ``by_row`` reads the cell of ``first_row``; without it (row ids that differ
    between scans) every cell of the column is compared by digest.
    """
    v = F.col("value")
    # cleaning at most doubles a text (a space at each change of case), so shorter raw cells cannot have a digest
    source = cells.select(*KEYS, "row_id", "value").filter(F.octet_length(v) * (2 if clean else 1) > SHORT)
    wanted = vd.filter(F.col("digest").isNotNull())
    if by_row:
        # rows without an id share one, their digests tell them apart
        none = F.lit(-(1 << 63)).cast("long")
        rows = wanted.select(*KEYS, F.coalesce("first_row", none).alias("_at")).distinct()
        source = source.withColumn("_at", F.coalesce("row_id", none)).join(rows, [*KEYS, "_at"], "left_semi")
    if clean:
        source = source.withColumn("value", F.when(F.col("kind") == TEXT, clean_text(v)).otherwise(v))
    source = source.filter(F.octet_length("value") > SHORT).withColumn("digest", F.md5("value"))
    keys = [*KEYS, "digest"]
    texts = source.join(wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.first("value").alias("_text"))
    long = wanted.join(texts, keys).withColumn("value", F.col("_text")).select(*vd.columns, "value")
    return vd.filter(F.col("digest").isNull()).withColumn("value", F.col("short")).unionByName(long)


def value_counts(cells: DataFrame, clean: bool = False, by_row: bool = True) -> DataFrame:
    """``(table_id, col_name, col_pos, kind, value, cnt, first_row)`` of all values that are not null."""
    vd = value_digests(cells, clean)
    return with_text(vd.filter(is_value(vd)), cells, clean, by_row).select(*KEYS, "value", "cnt", "first_row")


def _within(df: DataFrame, key: str, size: int, kind: str, most) -> DataFrame:
    """``df`` with ``_most``: at least ``size`` rows of the row's column have a ``key`` no larger.

    The least keys of hash slots belong to different rows, so the ``size``-th of them is such a bound; ``most`` where there are fewer.
    """
    columns = ["table_id", "col_name"]
    slot = F.pmod(F.xxhash64("short", "digest"), F.lit(max(SLOTS, 4 * size))).alias("_slot")
    least = df.groupBy(*columns, slot).agg(F.min(key).alias("_least")).groupBy(*columns).agg(F.array_sort(F.collect_list("_least")).alias("_least"))
    bound = least.select(*columns, F.coalesce(F.get("_least", F.lit(size - 1)), F.lit(most).cast(kind)).alias("_most"))
    return df.join(F.broadcast(bound), columns)


def _foremost(df: DataFrame, size: int, ties: bool) -> DataFrame:
    """The rows of ``df`` that can be among the first ``size`` of their column by ``_key`` and ``_head``, and few others, without a sort.

    With ``ties`` many rows may share a key: of them, those with the least beginnings.
    """
    if size < 1:
        return df.limit(0)
    near = _within(df, "_key", size, "double", float("inf")).filter(F.col("_key") <= F.col("_most"))
    if ties:
        # seven bytes of the head as a number: in the order of the heads, which have no byte 0 before their end or share the number
        start = F.conv(F.rpad(F.hex(F.substring(F.col("_head").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
        near = near.withColumn("_start", F.when(F.col("_key") < F.col("_most"), F.lit(-1).cast("long")).otherwise(start)).drop("_most")
        near = _within(near, "_start", size, "long", (1 << 63) - 1).filter(F.col("_start") <= F.col("_most")).drop("_start")
    return near.drop("_most")


def samples(
    vd: DataFrame, cells: DataFrame, n: int = 10, mode: str = "mixed", clean: bool = False, by_row: bool = True,
    seed: int = 42,
) -> DataFrame:
    """``(table_id, col_name, col_pos, kind, samples)``: as ``sampling.samples``, from value digests.

    Candidates are chosen by counts, draws and first characters; only their
    texts are fetched and only they are put in order by whole texts. ``seed`` is that
    of ``value_digests``.
    """
    if mode not in MODES:
        raise ValueError(f"unsupported sampling mode {mode!r}; use one of {MODES}")
    if mode in DRAWN:
        # a long value without its draw cannot be placed
        lost = F.col("digest").isNotNull() & F.col("draw").isNull()
        vd = vd.withColumn("draw", F.when(lost, F.raise_error(F.lit("value_digests needs a seed for this mode")).cast("double")).otherwise(F.col("draw")))
    vd = vd.filter(is_value(vd))
    # one row for each column: sent to all tasks, so that no column's values go to one task
    nd = vd.groupBy("table_id", "col_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    df = vd.join(F.broadcast(nd), ["table_id", "col_name"])
    unit = F.when(F.col("short").isNotNull(), md5_unit(F.col("short"))).otherwise(
        F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32))
    draw = F.coalesce("draw", seeded_unit(F.col("short"), seed))
    order = {
        "frequent": -F.col("cnt"), "mixed": -F.col("cnt"), "random": draw,
        "weighted": -F.log(F.greatest(draw, F.lit(1e-12))) / F.col("cnt"),
        "priority_sampling": -(F.col("cnt") / F.greatest(unit, F.lit(1e-12))), "consistent_sampling": -unit,
    }[mode].cast("double")
    # a short value is cut like a long one, so equal beginnings are ties, and ties all stay until texts are there
    df = df.withColumn("_key", order).withColumn("_head", F.substring(F.coalesce("short", "head"), 1, HEAD))
    size = n // 2 if mode == "mixed" else n
    big = df.filter(F.col("n_distinct") > n)
    w = Window.partitionBy("table_id", "col_name").orderBy("_key", "_head")
    near = _foremost(big, size, ties=mode in ("mixed", "frequent"))
    picked = near.withColumn("_r", F.rank().over(w)).filter(F.col("_r") <= size).drop("_r").withColumn("_why", F.lit(1))
    picked = picked.unionByName(df.filter(F.col("n_distinct") <= n).withColumn("_why", F.lit(0)))
    if mode == "mixed":
        parts = n - size
        picked = picked.unionByName(evenly_spread(big, parts).withColumn("_why", F.lit(2)))
    # about n rows for each column, read by every step of the fetch: written once (reliable checkpoint)
    picked = cut_lineage(picked)
    # columns with a long pick, at most all columns of the tables: the cells of other columns, mostly whole tables, are not read again
    columns = [F.col("table_id").eqNullSafe(r["table_id"]) & F.col("col_name").eqNullSafe(r["col_name"])
               for r in picked.filter(F.col("digest").isNotNull()).select("table_id", "col_name").distinct().collect()]
    if columns:
        texts = with_text(picked, cells.filter(reduce(or_, columns)), clean, by_row)
    else:
        texts = picked.withColumn("value", F.col("short"))
    exact = Window.partitionBy("table_id", "col_name", "_why").orderBy("_key", "value")
    chosen = texts.withColumn("_r", F.row_number().over(exact)).filter((F.col("_why") != 1) | (F.col("_r") <= size))
    by_key = mode in ("weighted", "priority_sampling", "consistent_sampling")
    natural = F.when(F.lit(mode in ("frequent", "random")) & (F.col("_why") == 1), natural_sort_key())
    place = F.when(F.lit(by_key) & (F.col("_why") == 1), F.col("_key")).otherwise(natural)
    # the most frequent and the evenly spread values of ``mixed`` overlap: a set keeps each once
    return chosen.groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_set(F.struct(place.alias("o"), F.col("value").alias("v")))), lambda s: s["v"]).alias("samples"))
