"""Session settings and the shared folder used to cut long plans."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the jobs are designed for. Shuffle partition counts stay with
# the cluster: AQE merges small ones and splits skewed ones.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A side whose parts are all this small when it has been shuffled is hashed, and neither side is sorted.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Results and intermediate tables are mostly text.
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.session.timeZone": "UTC",
    # Joins of published tables are put in order by their statistics; tables without any stay in the order written.
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
}


def apply_settings(spark: SparkSession) -> None:
    """Set the runtime settings on a session made elsewhere."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A runtime setting that holds in a block only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def many_tasks(spark: SparkSession) -> int:
    """How many tasks share a step whose rows take many times the room in memory that they take in a shuffle."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(cores: str = "*", partitions: int = 8, app: str = "ledgerloom") -> SparkSession:
    """Single-machine session for tests and the local bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a session whose executors are threads of the driver may name none; it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    context.setCheckpointDir(folder)
    return folder


#: The folder of the job that the current thread runs.
_RUN_FOLDER: ContextVar[str | None] = ContextVar("run_folder", default=None)


@contextmanager
def run_folder(spark: SparkSession, keep: bool = False) -> Iterator[str]:
    """Put all intermediate tables of a job into one folder, and remove that folder when the job has ended.

    Results that are read after the block must have been written elsewhere. With ``keep`` the folder stays, for the
    caller to remove.
    """
    folder = os.path.join(shared_dir(spark), "ledgerloom", uuid.uuid4().hex)
    outer = _RUN_FOLDER.set(folder)
    try:
        yield folder
    finally:
        _RUN_FOLDER.reset(outer)
        if not keep:
            remove_folder(spark, folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    run = _RUN_FOLDER.get() or os.path.join(shared_dir(spark), "ledgerloom")
    return os.path.join(run, uuid.uuid4().hex, name)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a dataset once to the shared folder and read it back.

    Used where several later datasets read the same one: it is computed once, survives
    the loss of an executor, and later scans still prune columns and push filters.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
