"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "queuelens") -> SparkSession:
    """A UTC session with adaptive execution.

    On a cluster leave ``shuffle_partitions`` unset: AQE starts from the
    configured initial number and coalesces to the advisory size.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per expression
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, and only in local
    mode: on a cluster a machine-local folder would be lost with its machine.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="queuelens-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand Python at most ``rows`` rows at a time in jobs that run inside; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_parts(spark: SparkSession) -> Iterator[None]:
    """Scans that are planned inside read 4 MB a task, small files together; a smaller setting of the session stays."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if size(before[0]) <= size("4m"):
        yield
        return
    for name, value in zip(names, ("4m", "64k")):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def cut_lineage(df: DataFrame, by: Sequence[str] = (), file_rows: int = 0) -> DataFrame:
    """Write to the shared folder and read back, in folders ``by`` columns and files of at most ``file_rows`` rows, if given.

    Used where a plan loops or is read many times. It survives lost executors,
    and unlike a checkpoint the table is planned by its real size: a checkpoint
    keeps the estimate of its plan, which grows with every join of a loop.
    """
    path = scratch_path(df.sparkSession, "table")
    out = df.write.option("maxRecordsPerFile", file_rows) if file_rows else df.write
    out.parquet(path, partitionBy=list(by) or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)
