"""Spark session helpers shared by tests, the bench and the query registry."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "colweave") -> SparkSession:
    """Local session with the settings this library assumes (UI off, AQE on, UTC)."""
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application (``addPyFile``).

    Pandas functions are pickled by reference, so Python workers must be able
    to import ``colweave`` wherever the driver was started from.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="colweave-py-"), "colweave.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the canonical cell text depends on and ship the package.

    Cell text renders timestamps as ISO strings; UTC keeps that rendering
    independent of the machine the driver runs on.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Only when the session has none (local tests) is a scratch folder set.
    """
    current = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        # a machine-local folder would not survive executor loss on a cluster
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store) for cluster runs")
    path = tempfile.mkdtemp(prefix="colweave-ckpt-")
    spark.conf.set(_CHECKPOINT_KEY, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(ensure_checkpoint_dir(spark))
    return df.checkpoint(eager=eager)
