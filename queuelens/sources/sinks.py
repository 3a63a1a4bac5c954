"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.sources.scan import scan_jsonl

JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", gzip: bool = False, mode: str = "error") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("timestampFormat", JSON_TIME)
    elif fmt in ("json", "jsonl"):
        fmt, writer = "json", writer.option("timestampFormat", JSON_TIME).option("ignoreNullFields", False)
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.format(fmt).save(path)


# --- dataset versions ----------------------------------------------------

INDEX = "version_id string, name string, file string, created_at timestamp, rows long"


def new_version(df: DataFrame, base: str, name: str, version_id: str, created_at) -> DataFrame:
    """Write a version and its index row; the row is written only after the data."""
    spark = df.sparkSession
    path = f"{base}/data/version={version_id}"
    df.write.mode("error").parquet(path)
    row = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(version_id).alias("version_id"), F.lit(name).alias("name"), F.lit(path).alias("file"),
        F.lit(created_at).cast("timestamp").alias("created_at"), "rows")
    row.write.mode("append").parquet(f"{base}/index")
    return row


def list_versions(spark: SparkSession, base: str, name_part: str = "") -> DataFrame:
    index = spark.read.schema(INDEX).parquet(f"{base}/index")
    return index.filter(F.contains(F.col("name"), F.lit(name_part))).orderBy(F.desc("created_at"), F.desc("version_id"))


def load_version(spark: SparkSession, base: str, version_id: str) -> DataFrame:
    return spark.read.parquet(f"{base}/data/version={version_id}")


# --- exports -------------------------------------------------------------

def export_points(points: DataFrame, name: str, since, path: str, fmt: str = "json", gzip: bool = False) -> None:
    """One metric since a time as ``ts,name,value,labels,source``."""
    rows = points.filter((F.col("name") == name) & (F.col("ts") >= F.lit(since))).select(
        "ts", "name", "value", F.to_json("labels").alias("labels"), "source")
    write_rows(rows, path, fmt, gzip)


def export_jsonl(df: DataFrame, path: str) -> None:
    write_rows(df, path, "jsonl")


def import_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return scan_jsonl(spark, path, schema)


def event_report(parts: dict[str, DataFrame], cutoff, times: dict[str, str]) -> DataFrame:
    """Recent rows of several tables as tagged JSON lines."""
    out = None
    for tag, df in parts.items():
        body = F.to_json(F.struct("*"), {"timestampFormat": JSON_TIME})
        rows = df.filter(F.col(times[tag]) >= F.lit(cutoff)).select(F.lit(tag).alias("type"), body.alias("line"))
        out = rows if out is None else out.unionAll(rows)
    return out


def invoice_export(invoices: DataFrame, since, currency: str = "USD") -> DataFrame:
    return invoices.filter(F.col("created_at") >= F.lit(since)).select(
        "invoice_id", "customer_id", "created_at", "total_cents", F.lit(currency).alias("currency"), "paid")


# --- keyed writes --------------------------------------------------------

def unseen_rows(store: DataFrame, batch: DataFrame, key: str, as_of, ts: str = "ts") -> DataFrame:
    """Rows of a batch whose key is not stored; of equal keys the earliest.

    A missing time becomes ``as_of``.
    """
    timed = batch.withColumn(ts, F.coalesce(F.col(ts), F.lit(as_of).cast("timestamp")))
    spec = Window.partitionBy(key).orderBy(ts, *[c for c in timed.columns if c not in (key, ts) and not isinstance(
        timed.schema[c].dataType, T.MapType)])
    first = timed.withColumn("_r", F.row_number().over(spec)).filter("_r = 1").drop("_r")
    return first.join(store.select(key), key, "left_anti")


def upsert_latest(store: DataFrame, batch: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Newest record per key of both; on equal times the batch wins."""
    both = store.withColumn("_from", F.lit(0)).unionByName(batch.withColumn("_from", F.lit(1)))
    spec = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col("_from").desc())
    return both.withColumn("_r", F.row_number().over(spec)).filter("_r = 1").drop("_r", "_from")


def retention_trim(df: DataFrame, ts: str, days: int, as_of) -> tuple[DataFrame, DataFrame]:
    """Rows young enough to keep, and one row with how many are dropped."""
    young = F.col(ts) >= F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter(young), df.agg(F.count_if(~young).alias("removed"), F.count_if(young).alias("kept"))


def summary_points(snapshot: DataFrame, measurement: str, as_of: Column) -> DataFrame:
    """One wide point per queue from a window snapshot; empty queues are absent."""
    return snapshot.filter(F.col("count") > 0).select(
        F.lit(measurement).alias("measurement"), F.col("name").alias("queue"), as_of.alias("time"),
        F.col("mean"), F.col("p95"), F.col("count"))


# --- streams -------------------------------------------------------------

def stream_to_tables(stream: DataFrame, base: str, route: str, checkpoint: str, interval: str | None = None):
    """Each micro-batch appended below one folder per collection.

    The batch id is part of the path, so a replayed batch overwrites itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(route).parquet(f"{base}/batch={batch_id}")
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def topic_message(df: DataFrame, key: str, headers: dict[str, str] | None = None) -> DataFrame:
    """Key, JSON value and headers of each row, as topics want them."""
    value = F.to_json(F.struct(*[c for c in df.columns if c != key]), {"timestampFormat": JSON_TIME})
    cols = [F.col(key).cast("string").alias("key"), value.alias("value")]
    if headers:
        cols.append(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("binary").alias("value"))
                              for k, v in headers.items()]).alias("headers"))
    return df.select(*cols)


def to_topic(stream: DataFrame, key: str, target: str, checkpoint: str, fmt: str = "kafka", options: dict[str, str] | None = None,
             headers: dict[str, str] | None = None):
    """Write messages to a topic, or as files where ``fmt`` is ``json`` or ``parquet``; ``headers`` go with each message."""
    out = topic_message(stream, key, headers)
    if fmt == "kafka" and headers:
        options = {"includeHeaders": "true", **(options or {})}
    writer = out.writeStream.format(fmt).options(**(options or {})).option("checkpointLocation", checkpoint)
    writer = writer.option("topic", target) if fmt == "kafka" else writer.option("path", target)
    return writer.trigger(availableNow=True).start()
