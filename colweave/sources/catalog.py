"""Table catalogue: whole tables in, long-form column relations out.

A column becomes rows: ``columns`` holds one row per column (schema only),
``cells`` one row per (row, column) as canonical text. Everything downstream
aggregates ``cells`` straight away, so the rows x columns blow-up never
reaches a shuffle unreduced (partial aggregation runs map-side).
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import clean_text, is_integer_text, is_number_text

TEXT, INT, FLOAT, BOOL = "text", "int", "float", "bool"

# order keys of the driver tables: first-occurrence order (mixed sampling,
# declared type) follows them instead of file position.
DEFAULT_ORDER_KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "events": "event_id",
    "documents": "doc_id",
    "labels": "doc_id",
    "embeddings": "vec_id",
    "pages": "page_id",
    "benchmark": "item_id",
}
COMPOSITE_ORDER_KEYS = {
    "lineitem": ("l_orderkey", "l_linenumber"),
    "conversations": ("conv_id", "turn"),
}


@dataclass(frozen=True)
class Table:
    """One catalogued table. ``order_key`` fixes row order; absent -> scan order."""

    table_id: str
    df: DataFrame
    order_key: str | tuple | None = None
    value_cols: tuple | None = None  # columns to catalogue; None = all

    def row_id(self) -> Column:
        key = self.order_key
        if key is None:
            return F.monotonically_increasing_id()
        if isinstance(key, str):
            return F.col(key).cast("long")
        # composite order: (k1, k2) -> k1 * 2^16 + k2. A pair that does not fit would share
        # another pair's id, so it ends the job instead.
        k1, k2 = F.col(key[0]).cast("long"), F.col(key[1]).cast("long")
        fits = k2.between(0, (1 << 16) - 1) & k1.between(-(1 << 46), (1 << 46) - 1)
        problem = F.concat(F.lit(f"{self.table_id}: row key does not fit: "), F.concat_ws(", ", k1.cast("string"), k2.cast("string")))
        return F.when(k1.isNull() | k2.isNull() | fits, k1 * F.lit(1 << 16) + k2).otherwise(F.raise_error(problem).cast("long"))


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> Table:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    key = DEFAULT_ORDER_KEYS.get(name) or COMPOSITE_ORDER_KEYS.get(name)
    return Table(name, df, key, tuple(columns) if columns is not None else None)


# FIXED VALUES: cells that CSV readers of data frames take as missing.
CSV_NULLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
CSV_BOOLS = ("True", "False", "TRUE", "FALSE", "true", "false")


def read_csv_table(spark: SparkSession, path: str, table_id: str | None = None, strip_headers: bool = True) -> Table:
    """CSV with header, null spellings and inferred types; header names stripped (SRC-1, SRC-2).

    Cells are read as text, the null spellings become null, and each column takes
    the type that all its other cells have: whole numbers (as floats where
    cells are missing), numbers, booleans or text. One pass over the file.
    """
    df = spark.read.option("header", True).csv(path)
    if strip_headers:
        df = df.toDF(*unique_names([c.strip() for c in df.columns]))
    cells = {c: F.when(~F.col(f"`{c}`").isin(*CSV_NULLS), F.col(f"`{c}`")) for c in df.columns}
    found = df.agg(F.count(F.lit(1)).alias("rows"), *[x for i, v in enumerate(cells.values()) for x in (
        F.count(v).alias(f"n{i}"), F.count(F.when(is_integer_text(v), 1)).alias(f"i{i}"),
        F.count(F.when(is_number_text(v), 1)).alias(f"f{i}"), F.count(F.when(v.isin(*CSV_BOOLS), 1)).alias(f"b{i}"))]).first()
    typed = []
    for i, (name, v) in enumerate(cells.items()):
        n = found[f"n{i}"]
        if n and found[f"i{i}"] == n and n == found["rows"]:
            out = F.trim(v).try_cast("long")
        elif n and found[f"f{i}"] == n:
            out = F.trim(v).try_cast("double")
        elif n and found[f"b{i}"] == n and n == found["rows"]:
            out = F.lower(v).try_cast("boolean")
        else:
            out = v
        typed.append(out.alias(name))
    return Table(table_id or os.path.splitext(os.path.basename(path))[0], df.select(*typed), None)


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return BOOL
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INT
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    return TEXT


def unique_names(names: list[str]) -> list[str]:
    """De-duplicate header names with ``.1``, ``.2`` suffixes, as CSV readers do."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            out.append(f"{n}.{seen[n]}")
        else:
            seen[n] = 0
            out.append(n)
    return out


def float_text(c: Column) -> Column:
    """A floating number as CSV text shows it: shortest digits, plain from 1e-4 up to 1e16.

    Java writes ``1.23456789E7`` and ``1.0E-4`` where data frames write
    ``12345678.9`` and ``0.0001``; outside that range ``1e+16`` and ``1e-05``.
    """
    s, a = c.cast("string"), F.abs(c.cast("double"))
    digits = F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    power = F.substring_index(s, "E", -1).try_cast("int")
    mantissa = F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", "")
    far = F.concat(mantissa, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.format_string("%02d", F.abs(power)))
    infinite = F.when(c.cast("double") > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    return (
        F.when(F.isnan(c), F.lit(None).cast("string")).when(s.contains("Inf"), infinite)
        .when(~s.contains("E"), s).when((a >= 1e-4) & (a < 1e16), plain).otherwise(far)
    )


def cell_text(name: str, dt: T.DataType) -> Column:
    """Canonical text of a cell, as a schema-inferring CSV reader would show it."""
    c = F.col(f"`{name}`")
    k = kind_of(dt)
    if k == BOOL:
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if k == FLOAT and not isinstance(dt, T.DecimalType):
        return float_text(c)
    if isinstance(dt, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(c)
    return c.cast("string")


def columns_relation(spark: SparkSession, tables: list[Table]) -> DataFrame:
    """``columns(table_id, col_name, col_pos, src_type, kind)`` from schemas (size = number of columns)."""
    rows = []
    for t in tables:
        sel = t.df.select(*[F.col(f"`{c}`") for c in (t.value_cols or t.df.columns)])
        names = unique_names(sel.columns)
        for pos, (n, f) in enumerate(zip(names, sel.schema.fields)):
            rows.append((t.table_id, n, pos, f.dataType.simpleString(), kind_of(f.dataType)))
    schema = "table_id string, col_name string, col_pos int, src_type string, kind string"
    return spark.createDataFrame(rows, schema)


def _fields(t: Table) -> tuple[DataFrame, list[tuple[int, T.StructField]]]:
    """The rows of a table with ``__row_id`` and unique names, and its columns by position."""
    src = t.df.select(t.row_id().alias("__row_id"), *[F.col(f"`{c}`") for c in (t.value_cols or t.df.columns)])
    df = src.toDF("__row_id", *unique_names(src.columns[1:]))
    return df, list(enumerate(df.schema.fields[1:]))


def _native(t: Table, f: T.StructField) -> str | None:
    """Type in which a column's values are counted before they are made text; None: text, nested or without row ids."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(f.dataType, whole):
        kind = "bigint"
    elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        kind = f.dataType.simpleString()
    else:
        return None
    return kind if t.order_key else None


def _table_cells(t: Table, clean: bool, native: bool = True) -> DataFrame | None:
    df, fields = _fields(t)
    fields = [(i, f) for i, f in fields if native or not _native(t, f)]
    if not fields:
        return None
    exprs = []
    for _, f in fields:
        v = cell_text(f.name, f.dataType)
        if clean and kind_of(f.dataType) == TEXT:
            v = clean_text(v)
        exprs.append(v.alias(f.name))
    wide = df.select(F.col("__row_id").alias("row_id"), *exprs)
    # not ``unpivot``: the code that Spark generates for what follows its Expand may not compile where expressions repeat,
    # and the stage is interpreted
    each = [F.struct(F.lit(f.name).alias("col_name"), F.lit(i).alias("col_pos"), F.lit(kind_of(f.dataType)).alias("kind"), F.col(f"`{f.name}`").alias("value"))
            for i, f in fields]
    return wide.select(F.lit(t.table_id).alias("table_id"), "row_id", F.inline(F.array(*each)))


def native_counts(tables: list[Table]) -> DataFrame | None:
    """``(table_id, row_id, col_name, col_pos, kind, value, cnt)`` of the columns that are not text: counted as numbers,
    dates or booleans, made text once for each different value; ``row_id`` is the first row. None without such columns.

    Two values may have one text, so counts are to be added up by it.
    """
    parts = []
    for t in tables:
        df, fields = _fields(t)
        for dt in dict.fromkeys(_native(t, f) for _, f in fields if _native(t, f)):
            own = [(i, f) for i, f in fields if _native(t, f) == dt]
            each = F.array(*[F.struct(F.lit(i).alias("col_pos"), F.col(f"`{f.name}`").cast(dt).alias("v")) for i, f in own])
            rows = df.select(F.col("__row_id").alias("row_id"), F.inline(each))
            # keys of groups have no negative zero, so it is told apart
            minus = (F.col("v") == 0) & F.col("v").cast("string").startswith("-") if dt in ("float", "double") else F.lit(False)
            counts = rows.groupBy("col_pos", "v", F.coalesce(minus, F.lit(False)).alias("minus")).agg(F.count(F.lit(1)).alias("cnt"), F.min("row_id").alias("row_id"))
            name = F.create_map(*[x for i, f in own for x in (F.lit(i), F.lit(f.name))])
            text = F.when(F.col("minus"), F.lit("-0.0")).otherwise(cell_text("v", rows.schema["v"].dataType))
            parts.append(counts.select(F.lit(t.table_id).alias("table_id"), "row_id", name[F.col("col_pos")].alias("col_name"), "col_pos",
                                       F.lit(kind_of(own[0][1].dataType)).alias("kind"), text.alias("value"), "cnt"))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def cells(tables: list[Table], clean: bool = True, native: bool = True) -> DataFrame | None:
    """``cells(table_id, row_id, col_name, col_pos, kind, value)``; text cells cleaned when ``clean``.

    Without ``native`` only the cells of columns that ``native_counts`` leaves out; None if there are none.
    """
    parts = [c for c in (_table_cells(t, clean, native) for t in tables) if c is not None]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def load_catalog(spark: SparkSession, sf_dir: str, names: list[str], columns: dict | None = None) -> list[Table]:
    columns = columns or {}
    return [read_table(spark, sf_dir, n, columns.get(n)) for n in names]


def lowercase_text(df: DataFrame) -> DataFrame:
    """Lower-case every string column, keep the rest (PRJ-3)."""
    return df.select(*[F.lower(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])
