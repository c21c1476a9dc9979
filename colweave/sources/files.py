"""Ground-truth, benchmark-folder and CSV-folder readers (SRC-3..6, SET-5).

All readers are plain ``spark.read`` calls; file identity comes from
``_metadata.file_path`` so a whole benchmark folder is one scan, not a driver
loop over files.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CSV_NULLS, unique_names


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def ranking_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``source_column -> target_column``; with repeated sources the last row wins (SRC-3)."""
    df = spark.read.option("header", True).csv(path).withColumn("_pos", F.monotonically_increasing_id())
    return df.groupBy("source_column").agg(F.max_by("target_column", "_pos").alias("target_column")).withColumnsRenamed(
        {"source_column": "source", "target_column": "target"}
    )


def pair_ground_truth(spark: SparkSession, path: str, positional: bool = False) -> DataFrame:
    """Distinct (source, target) pairs (SRC-4); ``positional`` takes the first two columns after dropping nulls."""
    df = spark.read.option("header", True).csv(path)
    if positional:
        a, b = df.columns[:2]
        df = df.select(F.col(f"`{a}`").alias("source"), F.col(f"`{b}`").alias("target")).dropna()
    else:
        df = df.select(F.col("source_column").alias("source"), F.col("target_column").alias("target"))
    return df.dropDuplicates()


def mapping_json(spark: SparkSession, path: str) -> DataFrame:
    """``{"matches": [{source_column, target_column}]}`` files -> pairs with their file (SRC-5)."""
    df = spark.read.option("multiLine", True).json(path).select("matches", F.col("_metadata.file_path").alias("file"))
    m = df.select("file", F.explode("matches").alias("m"))
    return m.select("file", F.col("m.source_column").alias("source"), F.col("m.target_column").alias("target"))


def benchmark_folder(spark: SparkSession, root: str, levels: int = 1) -> DataFrame:
    """Walk ``<root>/<pair>/<pair>_{source,target}.csv`` (or three levels) into one work list (SRC-6).

    Returns ``(pair_id, source_path, target_path, mapping_path)``; pairs whose
    mapping file holds no match are dropped (empty ground truth is skipped).
    """
    glob = "/".join(["*"] * levels)

    def files(pattern: str) -> DataFrame:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root}/{glob}/*")

    f = files("*.*").select("path").withColumn("pair_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn(
        "kind", F.regexp_extract("path", r"_(source|target|mapping)\.(csv|json)$", 1)
    ).filter(F.col("kind") != "")
    wide = f.groupBy("pair_id").pivot("kind", ["source", "target", "mapping"]).agg(F.first("path"))
    wide = wide.withColumnsRenamed({"source": "source_path", "target": "target_path", "mapping": "mapping_path"})
    matches = F.from_json(F.col("content").cast("string"), "matches array<struct<source_column:string,target_column:string>>")["matches"]
    non_empty = files("*_mapping.json").filter(F.size(matches) > 0).select(F.col("path").alias("mapping_path"))
    return wide.join(non_empty, "mapping_path", "left_semi")


#: Rows or cells in a batch.
BATCH = 10_000


def _csv_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def _records(content: bytes) -> Iterator[tuple[list[str], list[str]]]:
    """(header, cells) of every row of a CSV file; the header's names are stripped and told apart."""
    rows = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""))
    header = unique_names([c.strip() for c in next(rows, [])])
    for cells in rows:
        if cells:  # blank lines are no rows
            yield header, cells


def _known(cell: str | None) -> str | None:
    return None if cell in CSV_NULLS else cell


def csv_cells(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """``(file, row, col_pos, col_name, value)`` of every CSV file below a folder, each read by its own header (SET-5).

    One scan, a file in a task at a time; the driver sees neither names nor headers. Null spellings are
    null; cells that a short row lacks are null, those behind the last name are left out. A file without rows has no cells.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells():
            for b in batches:
                for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                    for row, (header, found) in enumerate(_records(content)):
                        for pos, column in enumerate(header):
                            yield name, row, pos, column, _known(found[pos]) if pos < len(found) else None

        source = cells()
        while batch := list(islice(source, BATCH)):
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*batch), kinds)], names=["file", "row", "col_pos", "col_name", "value"])

    return _csv_files(spark, path, pattern).mapInArrow(parse, "file string, row long, col_pos int, col_name string, value string")


def csv_union(spark: SparkSession, path: str, columns: list[str], pattern: str = "*.csv") -> DataFrame:
    """All rows of the CSV files below a folder by column name: ``file``, ``row`` and ``columns`` as text (SET-5).

    A file that lacks a column has nulls there; other columns are left out. Rows are formed where they are read, nothing is shuffled.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                    for row, (header, found) in enumerate(_records(content)):
                        cells = dict(zip(header, found))
                        yield name, row, *(_known(cells.get(c)) for c in columns)

        source = rows()
        while batch := list(islice(source, BATCH)):
            kinds = (pa.string(), pa.int64(), *[pa.string()] * len(columns))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*batch), kinds)], names=["file", "row", *columns])

    return _csv_files(spark, path, pattern).mapInArrow(parse, "file string, row long, " + ", ".join(f"`{c}` string" for c in columns))
