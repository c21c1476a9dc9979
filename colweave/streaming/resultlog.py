"""Append-only result log and resume (SNK-2, JOIN-10).

The log is a partitioned table in shared storage; appends are atomic per
write job, so a retried job never leaves half a row. ``pending`` is a
``left_anti`` join of the work list against the log.

A log with commits has a folder for every batch of a run and, written after it,
a manifest for that batch. Readers see only batches with a manifest, and a batch
that has one is never written again: a job that failed anywhere can be run again
from the start and leaves each of its results once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_RUN = re.compile(r"[A-Za-z0-9_.-]+")
_KEYS = "run string, batch long"


def append_results(results: DataFrame, path: str, partition_by: tuple[str, ...] = ("method",)) -> None:
    """Create-or-append (SNK-2): the first write creates the table with its schema."""
    results.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The log; with a ``schema`` an empty one where none was written yet. Any other trouble is raised:
    a log that cannot be read is not an empty log."""
    try:
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    except AnalysisException as e:
        if schema is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _folder(path: str, part: str, run: str, batch: int) -> str:
    if not _RUN.fullmatch(run):
        raise ValueError(f"a run is named by letters, digits, '_', '.' and '-': {run!r}")
    return f"{path.rstrip('/')}/{part}/run={run}/batch={int(batch)}"


def stage_batch(results: DataFrame, path: str, run: str, batch: int) -> int:
    """Write a batch's rows, in place of those an earlier attempt left; readers do not see them yet. Returns their number."""
    seen = Observation()
    results.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(_folder(path, "rows", run, batch))
    return int(seen.get["n"])


def mark_committed(spark: SparkSession, path: str, run: str, batch: int, n_rows: int) -> None:
    """Write the manifest of a staged batch: from now on it belongs to the log."""
    spark.createDataFrame([(n_rows,)], "n_rows long").coalesce(1).write.mode("overwrite").parquet(_folder(path, "commits", run, batch))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """run, batch, n_rows of all committed batches."""
    return read_results(spark, f"{path.rstrip('/')}/commits", f"n_rows long, {_KEYS}").select("run", "batch", "n_rows")


def commit_results(results: DataFrame, path: str, run: str, batch: int) -> bool:
    """Add a batch of a run to the log unless it is there; whether it was added.

    A run has one writer at a time. ``results`` must not have columns ``run`` or ``batch``.
    """
    spark = results.sparkSession
    if not commits(spark, path).filter((F.col("run") == run) & (F.col("batch") == int(batch))).isEmpty():
        return False
    mark_committed(spark, path, run, batch, stage_batch(results, path, run, batch))
    return True


def committed_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed batches with their ``run`` and ``batch``; ``schema`` is that of the results."""
    rows = read_results(spark, f"{path.rstrip('/')}/rows", f"{schema}, {_KEYS}")
    return rows.join(commits(spark, path).select("run", "batch"), ["run", "batch"], "left_semi")


def committing_sink(path: str, run: str) -> Callable[[DataFrame, int], None]:
    """A function for ``writeStream.foreachBatch``: micro-batches that are replayed are not added twice."""

    def sink(df: DataFrame, batch_id: int) -> None:
        commit_results(df, path, run, batch_id)

    return sink


def pending(worklist: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items whose keys are not in the log yet (JOIN-10)."""
    return worklist.join(done.select(*keys).distinct(), keys, "left_anti")


def worklist(tables: DataFrame, methods: list[str]) -> DataFrame:
    """(method, table) pairs: each table row expanded by the method list (a generator, not a join)."""
    return tables.select(F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"), "table_id")
