"""Helpers shared by the text operators: session set-up, table reads, shared scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colweave.session import ensure_checkpoint_dir, prepare

#: Rows in one Arrow batch: texts are long, so batches are kept short.
ARROW_ROWS = 256


#: What this Python worker keeps between tasks: owner -> how to forget it.
_KEPT: dict[str, Callable[[], None]] = {}


def begin(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Called where a task begins: tables that other owners left in this worker are forgotten.

    Workers live on from stage to stage, so without this the tables of all stages would add up.
    """
    for other in [o for o in _KEPT if o != owner]:
        _KEPT.pop(other)()
    if forget:
        _KEPT[owner] = forget


def setup(spark: SparkSession) -> SparkSession:
    """Ship the package and keep Arrow batches of long texts small."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/colweave-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there.

    Unlike a cached frame it survives the loss of any executor, and unlike a
    checkpoint it is compressed and can be read by column.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(text) -> "F.Column":
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def spread_join(left: DataFrame, right: DataFrame, key: str, n: str = "n", share: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has every key once and in ``n`` its rows in ``left``.

    Keys with more than one ``share``-th of the rows, fewer than ``share`` of them, are
    dealt over several tasks. ``right`` is read several times and should be a stored table.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    limit = max(1000, total // share)
    parts = F.ceil(F.col(n) / limit).cast("int")
    wide = right.filter(F.col(n) > limit).select(key, parts.alias("__parts"))
    dealt = left.join(F.broadcast(wide), key, "left").withColumn(
        "__part", F.pmod(F.monotonically_increasing_id(), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    copied = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(n)
    return dealt.join(copied, [key, "__part"]).drop("__part")
