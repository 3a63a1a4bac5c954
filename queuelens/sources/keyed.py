"""Tables that are written by key: appends without doubles, upserts, and retention, each touching only what it must.

A keyed table is a folder of Parquet partitions ``part=<n>``, a key's partition
being a hash of the key. A batch changes only the partitions its keys fall into:
they are read, joined with the batch, written to a staging folder and swapped in
by a dynamic partition overwrite. A ledger of batch ids, written last, makes a
repeated batch a no-op; one that died before its ledger entry is simply done
again, as both operations give the same rows when repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.sources.sinks import upsert_latest

PART = "part"


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path as one of its own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def subfolders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders right below a path that begin with ``prefix``; none where the path is missing."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return []
    return sorted(name for s in fs.listStatus(at) if s.isDirectory() and (name := s.getPath().getName()).startswith(prefix))


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``path`` whose rows are told apart by ``keys``, in ``parts`` partitions.

    ``parts`` is fixed for the life of the table. Choose it so that one partition is a comfortable task, some
    hundred MB: a batch rewrites the partitions of its keys, and no more.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: Sequence[str]
    parts: int = 64

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.parts)).cast("int")

    def _known(self) -> list[int]:
        return [int(name.split("=")[1]) for name in subfolders(self.spark, self.path, f"{PART}=")]

    def read(self, parts: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some partitions."""
        known = self._known()
        chosen = known if parts is None else [p for p in known if p in set(parts)]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.path}/{PART}={p}" for p in chosen]
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _applied(self, batch_id: str) -> bool:
        fs, at = _files(self.spark, f"{self.path}/_ledger/batch={batch_id}")
        return fs.exists(at)

    def _write(self, batch: DataFrame, batch_id: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        if self._applied(batch_id):
            return False
        staged, rows = f"{self.path}/_staged/batch={batch_id}", batch.select(*self.schema.names)
        incoming = f"{staged}/incoming"  # a batch may be dear to compute, and must not change between its readings
        rows.withColumn(PART, self._part()).write.mode("overwrite").partitionBy(PART).parquet(incoming)
        touched = [int(name.split("=")[1]) for name in subfolders(self.spark, incoming, f"{PART}=")]
        if touched:
            made = change(self.read(touched), self.spark.read.schema(self.schema).parquet(*[f"{incoming}/{PART}={p}" for p in touched]))
            made.withColumn(PART, self._part()).repartition(PART).write.mode("overwrite").partitionBy(PART).parquet(f"{staged}/merged")
            (self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())])).parquet(f"{staged}/merged")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path))
        self.spark.createDataFrame([(batch_id, len(touched))], "id string, parts int").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/_ledger/batch={batch_id}")
        fs, at = _files(self.spark, staged)
        fs.delete(at, True)
        return True

    def upsert(self, batch: DataFrame, batch_id: str, ts: str) -> bool:
        """The newest record of each key stays, on equal times the batch's; False if this batch was applied before.

        Null keys are a key like any other. A record with a null time is older than any other.
        """
        return self._write(batch, batch_id, lambda store, new: upsert_latest(store, new, self.keys, ts))

    def append_new(self, batch: DataFrame, batch_id: str, ts: str, as_of) -> bool:
        """Only keys that are not stored come in, of equal ones the earliest; a missing time becomes ``as_of``."""
        def change(store: DataFrame, new: DataFrame) -> DataFrame:
            first = new.withColumn(ts, F.coalesce(F.col(ts), F.lit(as_of).cast(self.schema[ts].dataType)))
            plain = [c for c in self.schema.names if c not in self.keys and c != ts and not isinstance(self.schema[c].dataType, T.MapType)]
            both = store.withColumn("_from", F.lit(0)).unionByName(first.withColumn("_from", F.lit(1)))
            order = F.struct("_from", ts, *plain)
            kept = both.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).agg(F.min_by(F.struct(*self.schema.names), order).alias("_row"))
            return kept.select("_row.*")

        return self._write(batch, batch_id, change)

    def upsert_stream(self, stream: DataFrame, ts: str, checkpoint: str, interval: str | None = None):
        """Every micro-batch upserted under its batch id, so that a replayed one changes nothing."""
        writer = (stream.writeStream.foreachBatch(lambda batch, n: self.upsert(batch, f"stream-{n}", ts))
                  .option("checkpointLocation", checkpoint))
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


# Days that each table keeps its rows.
RETENTION_DAYS = {"scaling_actions": 30, "scaling_summary": 7, "dlq_promotions": 30, "drift_events": 90, "correlation_stats": 30, "prioritymax_audit": 180}


def trim_days(spark: SparkSession, path: str, days: int, as_of_day: str, column: str = "day") -> DataFrame:
    """Delete the partitions ``<column>=<yyyy-mm-dd>`` of a table that are older than ``days`` before ``as_of_day``.

    Old days are found in the listing, counted from their files' footers and dropped whole: no row is read or
    written. The day that the limit falls on is kept. One row: ``days_removed``, ``removed``, ``days_kept``, ``kept``.
    """
    from datetime import date, timedelta
    limit = (date.fromisoformat(as_of_day) - timedelta(days=days)).isoformat()
    found = [n for n in subfolders(spark, path, f"{column}=") if n.split("=")[1][:4].isdigit()]
    old = [n for n in found if n.split("=")[1] < limit]
    count = lambda names: spark.read.parquet(*[f"{path}/{n}" for n in names]).count() if names else 0
    removed = count(old)
    for name in old:
        fs, at = _files(spark, f"{path}/{name}")
        fs.delete(at, True)
    young = [n for n in found if n not in old]
    return spark.createDataFrame([(len(old), removed, len(young), count(young))], "days_removed int, removed long, days_kept int, kept long")


def trim_all(spark: SparkSession, base: str, as_of_day: str) -> DataFrame:
    """``trim_days`` of every table of ``RETENTION_DAYS`` that exists below ``base``, one row a table."""
    out = None
    for name, days in RETENTION_DAYS.items():
        if subfolders(spark, f"{base}/{name}", "day="):
            row = trim_days(spark, f"{base}/{name}", days, as_of_day).select(F.lit(name).alias("table"), "*")
            out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "table string, days_removed int, removed long, days_kept int, kept long")
