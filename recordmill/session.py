"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "recordmill") -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster, use the session that spark-submit gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RECORDMILL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


#: Rows of a few numbers that may be broadcast.
BROADCAST_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where that is unset, and the master is local, a folder of this machine takes its place, and the setting is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="recordmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_folder(spark)}/recordmill/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: read many times, computed once, safe from lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._recordmill_path = path
    return stored


def release(*stored: DataFrame) -> None:
    """Deletes what materialize has written, once nothing that is still to be computed reads it."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._recordmill_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(stored: DataFrame) -> DataFrame:
    """The smaller side of a join, a stored table of a few numbers a row: broadcast if it is short enough, else shuffled."""
    return broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored.hint("shuffle_hash")
