"""Queries of section 2.8 and the stream source and sinks of 2.1 and 2.2."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuelens import fixtures as fx
from queuelens.catalog.aggregates import SNAP, T0, at
from queuelens.catalog import ordered as _ordered  # noqa: F401  (its SQL is reused)
from queuelens.catalog.registry import SQL, query
from queuelens.functions.columns import queue_key
from queuelens.operators import aggregates as ag
from queuelens.operators.aggregates import r6
from queuelens.session import scratch_path
from queuelens.sources import scan, sinks
from queuelens.streaming import jobs, ordered_state, panes, processors


def event_stream(spark, d):
    """The events file as a stream, times as instants."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = scan.read_stream(spark, "parquet", {"pathGlobFilter": "events.parquet"}, schema, d)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def point_stream(spark, d):
    return event_stream(spark, d).select(
        F.col("event_id").alias("key"), F.col("event_type").alias("name"),
        F.create_map(F.lit("k"), fx.k_of().cast("string"), F.lit("user"), F.col("user_id").cast("string")).alias("labels"), "value", "ts")


@query("stream_source", "SELECT * FROM events")
def stream_source(spark, d):
    return jobs.run_to_table(event_stream(spark, d), "source").withColumn("ts", fx.plain("ts"))


@query("micro_batch_sink", "SELECT event_type, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1")
def micro_batch_sink(spark, d):
    base = scratch_path(spark, "tables")
    sinks.stream_to_tables(event_stream(spark, d), base, "event_type", scratch_path(spark, "tables-checkpoint")).awaitTermination()
    return spark.read.parquet(base).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("id_sum"))


@query("stream_sink", """SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS messages, CAST(sum(event_id) AS BIGINT) AS id_sum, count(*) AS from_here, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum
    FROM events GROUP BY 1""")
def stream_sink(spark, d):
    """Messages with a header each; the value's own JSON text is read back from inside the message."""
    path = scratch_path(spark, "topic")
    sinks.to_topic(event_stream(spark, d), "user_id", path, scratch_path(spark, "topic-checkpoint"), "parquet", headers={"origin": "here"}).awaitTermination()
    origin = F.filter("headers", lambda h: h["key"] == "origin")[0]["value"].cast("string")
    number = lambda text, at: F.get_json_object(text, at).cast("long")
    return spark.read.parquet(path).groupBy("key").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(number("value", "$.event_id")).alias("id_sum"), F.count_if(origin == "here").alias("from_here"),
        F.sum(number(F.get_json_object("value", "$.props"), "$.k")).alias("k_sum"))


@query("stream_rollup", """WITH w AS (SELECT to_timestamp(floor(epoch(ts) / 60) * 60) AT TIME ZONE 'UTC' AS window_start, name, '{"k":"' || k || '","user":"' || user_id || '"}' AS labels, value FROM metric_points)
    SELECT window_start, name, labels, count(*) AS count, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM w
    WHERE window_start + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM metric_points) GROUP BY 1, 2, 3""", ("metric_points",))
def stream_rollup(spark, d):
    out = jobs.run_to_table(jobs.stream_rollup(point_stream(spark, d)), "rollup")
    return out.select(fx.plain("window_start").alias("window_start"), "name", "labels", "count", r6("avg").alias("avg"), "min", "max")


WINDOWS = (60, 300, 900, 3600)
#: A row that only moves the watermark, so that the last windows come out.
LAST = "2024-03-01 00:00:00"


@query("stream_sliding", f"""WITH p AS (SELECT name, value, w, unnest(range(0, w // 60)) AS i, floor(epoch(ts) / 60) AS pane FROM metric_points, (VALUES {", ".join(f"({w})" for w in WINDOWS)}) v(w)),
    g AS (SELECT name, CAST(w AS BIGINT) AS window_s, to_timestamp((pane + 1 + i) * 60) AT TIME ZONE 'UTC' AS window_end, list_sort(list(value)) AS v, sum(value) AS sum FROM p GROUP BY ALL)
    SELECT name, window_s, window_end, len(v) AS count, round(sum, 6) AS sum, round(sum / len(v), 6) AS mean, v[1] AS min, v[len(v)] AS max,
    v[CAST(ceil(len(v) * 0.5::DOUBLE) AS INTEGER)] AS p50, v[CAST(ceil(len(v) * 0.95::DOUBLE - 1e-9) AS INTEGER)] AS p95 FROM g""", ("metric_points",))
def stream_sliding(spark, d):
    points = point_stream(spark, d).select("name", "value", "ts").schema
    source = scratch_path(spark, "points")
    fx.metric_points(spark, d).select("name", "value", "ts").repartition(6, F.xxhash64("ts")).write.parquet(source)
    live = lambda: panes.stream_windows(scan.read_stream(spark, "parquet", {"maxFilesPerTrigger": "6"}, points, source), WINDOWS)
    path, checkpoint = scratch_path(spark, "sliding"), scratch_path(spark, "sliding-checkpoint")
    jobs.run_to_table(live(), "sliding", path, checkpoint)
    spark.createDataFrame([(LAST,)], "at string").select(F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("value"), F.to_timestamp("at").alias("ts")
                                                         ).write.mode("append").parquet(source)
    out = jobs.run_to_table(live(), "sliding", path, checkpoint).filter("name IS NOT NULL")
    return out.withColumns({"sum": r6("sum"), "mean": r6("mean"), "window_end": fx.plain("window_end")})


@query("stream_dedup", "SELECT event_id, event_type, value FROM events")
def stream_dedup(spark, d):
    twice = event_stream(spark, d).unionAll(event_stream(spark, d))
    return jobs.run_to_table(jobs.stream_dedup(twice, "event_id"), "dedup").select("event_id", "event_type", "value")


@query("late_policy", """WITH b AS (SELECT event_id % 4 AS batch_id, ts FROM events), m AS (SELECT batch_id, max(ts) AS top FROM b GROUP BY 1), u AS (SELECT batch_id, max(top) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM m)
    SELECT batch_id, count(*) AS rows, count(*) FILTER (ts < top - INTERVAL 20 DAY) AS late FROM b JOIN u USING (batch_id) GROUP BY 1""")
def late_policy(spark, d):
    """Four batches that cover the same month: from the second on, rows more than 20 days older than the newest are late."""
    ev = fx.table(spark, d, "events")
    source = scratch_path(spark, "batches")
    for low in range(4):  # one after the other: files are taken in the order they were written
        ev.filter(F.col("event_id") % 4 == low).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(source)
    base = scratch_path(spark, "late")
    jobs.late_rows(stream, 20 * 86400, base, scratch_path(spark, "late-checkpoint"))
    return spark.read.parquet(f"{base}/late/*")


RETRY_SQL = """WITH e AS (SELECT event_id, CAST(event_id % 7 AS INTEGER) AS attempts, event_type = 'error' AS failed, value > 2 AS ok FROM events)
    SELECT event_id AS original_id, CASE WHEN NOT ok THEN 'value' WHEN attempts + 1 >= 5 THEN 'max_retries' END AS error, CASE WHEN ok AND attempts + 1 < 5 THEN 'retry' ELSE 'dlq' END AS target,
    CASE WHEN ok AND attempts + 1 < 5 THEN CAST(floor(30 * pow(2.0, attempts)) AS INTEGER) END AS delay_s FROM e WHERE NOT ok OR failed"""


@query("stream_retry_dlq", RETRY_SQL)
def stream_retry_dlq(spark, d):
    base = scratch_path(spark, "retry")
    jobs.stream_retry_dlq(event_stream(spark, d), {"value": F.col("value") > 2}, "event_id", F.to_json(F.struct("event_id", "value")),
                          F.col("event_type") == "error", F.col("event_id") % 7, base, scratch_path(spark, "retry-checkpoint"), at(T0))
    retry = spark.read.parquet(f"{base}/retry/*").select("original_id", F.lit(None).cast("string").alias("error"), F.lit("retry").alias("target"), "delay_s")
    dlq = spark.read.parquet(f"{base}/dlq/*").select("original_id", "error", F.lit("dlq").alias("target"), F.lit(None).cast("int").alias("delay_s"))
    return retry.unionByName(dlq)


@query("dlq_replay", """WITH q AS (SELECT task_id, concat_ws(':', 'queue', tenant, task_type) AS queue_key, created_at, status FROM tasks), b AS (SELECT queue_key, count(*) AS n FROM q WHERE status = 'pending' GROUP BY 1),
    d AS (SELECT q.*, coalesce(n, 0) <= 200 AND created_at <= TIMESTAMP '2000-01-01' - INTERVAL 120 SECOND AS ok FROM q LEFT JOIN b USING (queue_key) WHERE status = 'dead'),
    r AS (SELECT *, row_number() OVER (PARTITION BY queue_key, ok ORDER BY created_at, task_id) AS rn FROM d) SELECT task_id, queue_key, CASE WHEN ok AND rn <= 3 THEN 'replay' ELSE 'stay' END AS action, '{"task":' || task_id || '}' AS payload FROM r""", ("tasks",))
def dlq_replay(spark, d):
    t = fx.tasks(spark, d).withColumn("queue_key", queue_key("tenant", "task_type"))
    dead = t.filter(F.col("status") == "dead").select("task_id", "queue_key", F.col("created_at").alias("ts"), F.lit("timeout").alias("error"),
                                                      F.concat(F.lit('{"task":'), F.col("task_id").cast("string"), F.lit("}")).alias("payload"))
    backlog = t.filter(F.col("status") == "pending").groupBy("queue_key").agg(F.count(F.lit(1)).alias("backlog"))
    go, stay = jobs.dlq_replay(dead, backlog, at("2000-01-01 00:00:00"), 3, 120, 200)
    return go.select("task_id", "queue_key", F.lit("replay").alias("action"), "payload").unionByName(
        stay.select("task_id", "queue_key", F.lit("stay").alias("action"), "payload"))


DEADLINE_SQL = """WITH e AS (SELECT task_id, event, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS nx FROM task_history)
    SELECT task_id, us + {us} AS deadline_us FROM e WHERE {arm} AND (nx > us + {us} OR (nx IS NULL AND us + {us} <= (SELECT max(epoch_us(ts)) - 600000000 FROM task_history)))"""


def history_stream(spark, d):
    kind = F.col("event_type")
    return event_stream(spark, d).select(
        F.col("user_id").alias("task_id"), F.when(kind == "error", "fail").when(kind == "signup", "enqueue").when(kind == "view", "dequeue")
        .otherwise("ack").alias("event"), "ts")


@query("visibility_timeout", DEADLINE_SQL.format(us=7_200_000_000, arm="event = 'dequeue'"), ("task_history",))
def visibility_timeout(spark, d):
    out = processors.stream_deadlines(history_stream(spark, d), "task_id", ["dequeue"], 7200)
    return jobs.run_to_table(out, "visibility")


@query("worker_liveness", """SELECT user_id AS worker_id, max(ts) AS last_seen, round(epoch(TIMESTAMP '2024-01-20') - epoch(max(ts)), 6) AS age_s, epoch(TIMESTAMP '2024-01-20') - epoch(max(ts)) > 7200 AS stale,
    epoch(TIMESTAMP '2024-01-20') - epoch(max(ts)) > 18000 AS hung FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1""")
def worker_liveness(spark, d):
    beats = fx.table(spark, d, "events").select(F.col("user_id").alias("worker_id"), "ts")
    out = jobs.worker_liveness(beats, at(T0), 7200, 3600)
    return out.withColumns({"last_seen": fx.plain("last_seen"), "age_s": r6("age_s")})


@query("worker_liveness_stream", DEADLINE_SQL.format(us=86_400_000_000, arm="true"), ("task_history",))
def worker_liveness_stream(spark, d):
    out = processors.stream_deadlines(history_stream(spark, d), "task_id", ["dequeue", "ack", "fail", "enqueue"], 86400)
    return jobs.run_to_table(out, "liveness")


ALERTS = [("click", 3600, "mean", 30.0), ("view", 86400, "p95", 60.0), ("error", 86400, "mean", 1000.0), ("purchase", 86400, "max", 20.0), ("signup", 86400, "p50", 5.0)]
ALERT_SQL = ", ".join(f"('{n}', {w}, '{s}', {t}::DOUBLE)" for n, w, s, t in ALERTS)


@query("threshold_alerts", f"""{SNAP.replace('SELECT name, window_s, count(*) AS count', ', s AS (SELECT name, window_s, count(*) AS count', 1)}), l AS (UNPIVOT (SELECT name, window_s, mean, p50, p95, min, max, sum FROM s)
    ON mean, p50, p95, min, max, sum INTO NAME stat VALUE value) SELECT l.name, l.window_s, l.stat, l.value, r.threshold FROM l JOIN (VALUES {ALERT_SQL}) r(name, window_s, stat, threshold)
    ON l.name = r.name AND l.window_s = r.window_s AND l.stat = r.stat WHERE value >= threshold""", ("metric_points",))
def threshold_alerts(spark, d):
    snap = ag.window_snapshot(fx.metric_points(spark, d), [60, 300, 900, 3600, 86400], at(T0))
    rules = spark.createDataFrame(ALERTS, "name string, window_s int, stat string, threshold double")
    return jobs.threshold_alerts(snap, rules)


@query("stale_pending", """SELECT task_id AS id, (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(created_at)) / 1000 AS idle_ms FROM tasks WHERE status = 'pending' AND created_at <= TIMESTAMP '1999-12-01' ORDER BY idle_ms DESC, id LIMIT 50""", ("tasks",))
def stale_pending(spark, d):
    pending = fx.tasks(spark, d).filter(F.col("status") == "pending").select(F.col("task_id").alias("id"), F.col("created_at").alias("delivered_at"))
    return jobs.stale_pending(pending, 31 * 86_400_000, at("2000-01-01 00:00:00"), 50).select("id", "idle_ms")


@query("heal_request_log", """WITH r AS (SELECT event_type AS action, user_id % 5 AS target, event_id, ts, count(*) OVER (PARTITION BY event_type, user_id % 5 ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) > 3 AS lim FROM events)
    SELECT action, CASE WHEN lim THEN 'rate_limited' WHEN event_id % 9 = 0 THEN 'pending' WHEN event_id % 4 = 0 THEN 'failed' ELSE 'executed' END AS status, count(*) AS requests FROM r GROUP BY 1, 2""")
def heal_request_log(spark, d):
    req = fx.table(spark, d, "events").select(
        F.col("event_type").alias("action"), (F.col("user_id") % 5).alias("target"), "ts", (F.col("event_id") % 9 != 0).alias("scheduled"),
        (F.col("event_id") % 4 == 0).alias("failed"))
    return jobs.heal_request_log(req, 3, 21600)


HOLD = 21_600
DELAY_DAYS = 2
#: Rows whose stretch the watermark has passed at the end of the stream.
RELEASED = f"""(floor(epoch_us(ts) / {HOLD}e6) + 1) * {HOLD}e6 <= (SELECT max(epoch_us(ts)) FROM events) - {DELAY_DAYS}::BIGINT * 86400000000"""


def released(key):
    """A batch query's SQL, for the rows that the stream has released."""
    return f"SELECT made.* FROM ({SQL[key]}) made JOIN events USING (event_id) WHERE {RELEASED}"


def shuffled_stream(spark, d):
    """Events spread over files that overlap by up to two days, one file a trigger."""
    ev = fx.table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")
    delayed = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(DELAY_DAYS * 86_400))
    path = scratch_path(spark, "shuffled")
    chunk = F.floor((delayed - F.unix_seconds(F.to_timestamp(F.lit("2024-01-01")))) / F.lit(8 * 86_400))
    for low in range(4):  # one after the other: files are taken in the order they were written
        ev.filter(chunk == low).repartition(1).write.mode("append").parquet(path)
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)


LATE = {"delay": f"{DELAY_DAYS} days", "hold_seconds": HOLD}


@query("stream_stateful_scans", released("circuit_breaker"))
def stream_stateful_scans(spark, d):
    live = shuffled_stream(spark, d).withColumns({"target": F.col("user_id") % 20, "ok": F.col("event_type") != "error"})
    out = ordered_state.stream_breaker(live, "target", "ts", ["event_id"], "streak", how=LATE, trip=2, open_s=43200, successes=3)
    return jobs.run_to_table(out, "scan").select("event_id", "target", "state", "allowed")


@query("stream_ewma", released("ewma"), recursive=True)
def stream_ewma(spark, d):
    out = ordered_state.stream_ewma(shuffled_stream(spark, d), "user_id", "ts", ["event_id"], "value", **LATE)
    return jobs.run_to_table(out, "ewma").select("event_id", r6(F.col("ewma") + 1e-9).alias("ewma"))


@query("stream_hysteresis", released("hysteresis_actions"), ("scaling_actions",))
def stream_hysteresis(spark, d):
    score = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("value") - 50) / 50))
    out = ordered_state.stream_hysteresis(shuffled_stream(spark, d).withColumn("score", score), "event_type", "ts", ["event_id"], "score", **LATE)
    return jobs.run_to_table(out, "hysteresis").select("event_id", "kept_score", "kept_action")


@query("stream_cooldown", released("cooldown_filter"))
def stream_cooldown(spark, d):
    out = ordered_state.stream_cooldown(shuffled_stream(spark, d), "user_id", "ts", ["event_id"], 86400, **LATE)
    return jobs.run_to_table(out, "cooldown").select("event_id", "user_id")


@query("stream_token_bucket", released("token_bucket"))
def stream_token_bucket(spark, d):
    out = ordered_state.stream_token_bucket(shuffled_stream(spark, d), "user_id", "ts", ["event_id"], 0.00005, 3.0, **LATE)
    return jobs.run_to_table(out, "bucket").select("event_id", "allowed")
