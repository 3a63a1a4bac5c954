"""Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelens.operators.aggregates import label_text
from queuelens.operators.slices import limit_early, micros
from queuelens.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB: needed by ``transformWithState`` and kept off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_table(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is available into a Parquet table and read it back."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    checkpoint = checkpoint or scratch_path(spark, f"{name}-checkpoint")
    (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)


def stream_rollup(stream: DataFrame, delay: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """Per interval, name and full label set: count, mean, min, max."""
    return (stream.withWatermark("ts", delay).groupBy(F.window("ts", every), "name", label_text().alias("labels"))
            .agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "name", "labels",
                    "count", "avg", "min", "max"))


def stream_dedup(stream: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """Each idempotency key once within the watermark delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def late_rows(stream: DataFrame, delay_seconds: int, base: str, checkpoint: str) -> None:
    """Count rows older than the newest time of earlier batches minus a delay.

    What earlier batches saw is one number a batch, the newest time so far, in a
    folder of the batch beside the counts. A batch reads that of the one before
    it, so a replayed or restarted batch gives the same answer, and removes the
    one before that.
    """
    spark = stream.sparkSession
    progress, counts = f"{base}/progress", f"{base}/late"
    schema = "newest long"

    def handle(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.schema(schema).parquet(f"{progress}/b{batch_id - 1}").first()["newest"] if batch_id else None
        us = micros("ts")
        late = F.lit(False) if before is None else us < before - delay_seconds * 1_000_000
        out = batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late"), F.max(us).alias("newest")).first()
        newest = max((t for t in (before, out["newest"]) if t is not None), default=None)
        spark.createDataFrame([(batch_id, out["rows"], out["late"])], "batch_id long, rows long, late long").write.mode(
            "overwrite").parquet(f"{counts}/b{batch_id}")
        spark.createDataFrame([(newest,)], schema).write.mode("overwrite").parquet(f"{progress}/b{batch_id}")
        if batch_id > 1:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{progress}/b{batch_id - 2}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_retry_dlq(stream: DataFrame, rules: dict[str, Column], key: str, payload: Column, failed: Column, attempts: Column,
                     base: str, checkpoint: str, as_of, max_retries: int = 5) -> None:
    """Split each batch: schema failures and exhausted rows to the DLQ, other
    failed rows to the retry table with their delay."""
    from queuelens.operators.rows import retry_decision, validate_route

    def handle(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            valid, dead = validate_route(held, rules, "stream", payload, key, as_of)
            rule = retry_decision(attempts, max_retries)
            tried = valid.filter(failed).select(F.col(key).alias("original_id"), payload.alias("payload"),
                                                *[c.alias(n) for n, c in rule.items()])
            spent = tried.filter(F.col("decision") == "dead").select(
                "original_id", F.lit("stream").alias("source"), "payload", F.lit("max_retries").alias("error"),
                F.lit(as_of).alias("ts"), F.lit(False).alias("retry"))
            dead.unionByName(spent).write.mode("overwrite").parquet(f"{base}/dlq/b{batch_id}")
            tried.filter(F.col("decision") == "retry").write.mode("overwrite").parquet(f"{base}/retry/b{batch_id}")
        finally:
            held.unpersist()

    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


# --- batch forms ---------------------------------------------------------

def dlq_replay(dlq: DataFrame, backlog: DataFrame, as_of, limit: int = 200, min_age_s: int = 120, max_backlog: int = 100,
               hint: float = 0.0, max_hint: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Entries to replay, oldest first, and the entries that stay.

    A queue replays only while its backlog is small and the scaling hint low.
    Only replayed entries leave the DLQ; they keep all their columns, the payload
    among them, and are marked with where they come from.
    """
    limit_early(dlq, limit)
    aged = (dlq.join(backlog, "queue_key", "left").fillna(0, ["backlog"])
            .withColumn("_ok", (F.unix_micros(F.lit(as_of)) - F.unix_micros("ts") >= min_age_s * 1_000_000)
                        & (F.col("backlog") <= max_backlog) & F.lit(hint <= max_hint)))
    spec = Window.partitionBy("queue_key").orderBy("ts", "task_id")
    chosen = (aged.filter("_ok").withColumn("_r", F.row_number().over(spec)).filter(F.col("_r") <= limit)
              .select(*dlq.columns, F.col("task_id").alias("dlq_original_id"), F.col("error").alias("dlq_error"),
                      F.lit(as_of).alias("dlq_replayed_ts")))
    stays = dlq.join(chosen.select("task_id"), "task_id", "left_anti")
    return chosen, stays


def worker_liveness(beats: DataFrame, as_of, stale_s: int = 60, interval_s: int = 30) -> DataFrame:
    """Last heartbeat and age per worker; stale after ``stale_s``, hung after five intervals."""
    last = beats.filter(F.col("ts") <= F.lit(as_of)).groupBy("worker_id").agg(F.max("ts").alias("last_seen"))
    age = (F.unix_micros(F.lit(as_of)) - F.unix_micros("last_seen")) / 1e6
    return last.withColumn("age_s", age).withColumns({"stale": F.col("age_s") > stale_s, "hung": F.col("age_s") > 5 * interval_s})


def threshold_alerts(snapshot: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose named statistic of the metric's window reaches the threshold."""
    stats = snapshot.select("name", "window_s", F.explode(F.create_map(*[
        x for s in ("mean", "p50", "p95", "min", "max", "sum") for x in (F.lit(s), F.col(s))])).alias("stat", "value"))
    return stats.join(rules, ["name", "window_s", "stat"]).filter(F.col("value") >= F.col("threshold"))


def stale_pending(pending: DataFrame, min_idle_ms: int, as_of, limit: int = 50) -> DataFrame:
    """Entries idle for at least ``min_idle_ms``, longest first."""
    idle = (F.unix_micros(F.lit(as_of)) - F.unix_micros("delivered_at")) / 1000
    return pending.withColumn("idle_ms", idle).filter(F.col("idle_ms") >= min_idle_ms).orderBy(F.desc("idle_ms"), "id").limit(limit)


def heal_request_log(requests: DataFrame, limit: int = 3, window_s: int = 300) -> DataFrame:
    """Outcome counts per action: rate-limited requests fail before they run."""
    from queuelens.operators.ordered import rate_limit_flags
    flagged = rate_limit_flags(requests, ["action", "target"], limit, window_s)
    outcome = F.when(F.col("limited"), "rate_limited").when(~F.col("scheduled"), "pending").when(F.col("failed"), "failed").otherwise("executed")
    return flagged.groupBy("action", outcome.alias("status")).agg(F.count(F.lit(1)).alias("requests"))
