"""Queries of section 2.2."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens import fixtures as fx
from queuelens.catalog.aggregates import T0, at
from queuelens.catalog.registry import query
from queuelens.operators import aggregates as ag
from queuelens.session import scratch_path
from queuelens.sources import keyed, scan, sinks
from queuelens.operators.scalars import beside


@query("write_rows", """SELECT f AS fmt, l_returnflag, count(*) AS rows, round(sum(l_extendedprice), 2) AS total, max(l_shipdate) AS last
    FROM lineitem, (SELECT unnest(['csv', 'jsonl', 'parquet']) AS f) GROUP BY 1, 2""")
def write_rows(spark, d):
    li = fx.table(spark, d, "lineitem")
    out = None
    for fmt, gzip in (("csv", True), ("jsonl", True), ("parquet", False)):
        path = f"{scratch_path(spark, 'rows')}.{fmt}"
        sinks.write_rows(li, path, fmt, gzip)
        got = scan.scan_auto(spark, [path], li.schema).groupBy("l_returnflag").agg(
            F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("total"), fx.plain(F.max("l_shipdate")).alias("last"))
        got = got.withColumn("fmt", F.lit(fmt))
        out = got if out is None else out.unionByName(got)
    return out


@query("dataset_version", """SELECT 'v' || k AS version_id, CASE WHEN k < 2 THEN 'lines_a' ELSE 'lines_b' END AS name, count(*) AS rows, round(sum(l_quantity), 2) AS loaded_sum
    FROM lineitem, (SELECT unnest([0, 1, 2]) AS k) WHERE l_orderkey % 3 = k GROUP BY k""")
def dataset_version(spark, d):
    li = fx.table(spark, d, "lineitem")
    base = scratch_path(spark, "versions")
    for k in range(3):
        sinks.new_version(li.filter(F.col("l_orderkey") % 3 == k), base, "lines_a" if k < 2 else "lines_b", f"v{k}", f"2024-01-0{k + 1} 00:00:00")
    sums = None
    for k in range(3):
        one = sinks.load_version(spark, base, f"v{k}").agg(F.round(F.sum("l_quantity"), 2).alias("loaded_sum")).withColumn("version_id", F.lit(f"v{k}"))
        sums = one if sums is None else sums.unionByName(one)
    return sinks.list_versions(spark, base, "lines").join(sums, "version_id").select("version_id", "name", "rows", "loaded_sum")


POINT = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()),
                      T.StructField("labels", T.StringType()), T.StructField("source", T.StringType())])


@query("export_points", """SELECT ts, name, value, '{"k":"' || k || '","user":"' || user_id || '"}' AS labels, source, f AS fmt FROM metric_points, (SELECT unnest(['csv', 'jsonl']) AS f)
    WHERE name = 'click' AND ts >= TIMESTAMP '2024-01-20'""", ("metric_points",))
def export_points(spark, d):
    points, out = fx.metric_points(spark, d), None
    for fmt, gzip in (("csv", False), ("jsonl", True)):
        path = f"{scratch_path(spark, 'points')}.{fmt}"
        sinks.export_points(points, "click", at(T0), path, fmt, gzip)
        if fmt == "csv":
            got = spark.read.schema(POINT).option("header", True).csv(path)
        else:
            got = scan.scan_jsonl(spark, path, POINT)
        got = got.withColumn("fmt", F.lit(fmt))
        out = got if out is None else out.unionByName(got)
    return out.withColumn("ts", fx.plain("ts"))


@query("export_import_collection", "SELECT * FROM customer")
def export_import_collection(spark, d):
    cu = fx.table(spark, d, "customer")
    path = scratch_path(spark, "collection")
    sinks.export_jsonl(cu, path)
    return sinks.import_jsonl(spark, path, cu.schema)


@query("event_report", """SELECT type, count(*) AS lines, CAST(sum(id) AS BIGINT) AS id_sum FROM (SELECT 'task' AS type, task_id AS id FROM tasks WHERE created_at >= TIMESTAMP '1998-01-01'
    UNION ALL SELECT 'history', event_id FROM task_history WHERE ts >= TIMESTAMP '1998-01-01') GROUP BY 1""", ("tasks", "task_history"))
def event_report(spark, d):
    parts = {"task": fx.tasks(spark, d), "history": fx.task_history(spark, d)}
    lines = sinks.event_report(parts, at("1998-01-01 00:00:00"), {"task": "created_at", "history": "ts"})
    path = scratch_path(spark, "report")
    sinks.write_rows(lines, path, "jsonl", gzip=True)
    back = scan.scan_jsonl(spark, path, lines.schema)
    ident = F.coalesce(F.get_json_object("line", "$.event_id"), F.get_json_object("line", "$.task_id")).cast("long")
    return back.groupBy("type").agg(F.count(F.lit(1)).alias("lines"), F.sum(ident).alias("id_sum"))


@query("invoice_csv", """SELECT invoice_id, customer_id, created_at, total_cents, 'USD' AS currency, paid FROM invoices WHERE created_at >= TIMESTAMP '1998-01-01'""", ("invoices",))
def invoice_csv(spark, d):
    rows = sinks.invoice_export(fx.invoices(spark, d), at("1998-01-01 00:00:00"))
    path = scratch_path(spark, "invoices")
    sinks.write_rows(rows, path, "csv")
    return scan.scan_csv(spark, path, rows.schema).withColumn("created_at", fx.plain("created_at"))


@query("append_idempotent", """SELECT event_id, CASE WHEN event_id % 4 = 0 OR event_id % 6 <> 0 THEN ts ELSE TIMESTAMP '2024-02-01' END AS ts, CASE WHEN event_id % 4 = 0 THEN 'store' ELSE 'batch' END AS origin
    FROM events WHERE event_id % 4 = 0 OR event_id % 2 = 0""")
def append_idempotent(spark, d):
    ev = fx.table(spark, d, "events").select("event_id", "ts")
    store = ev.filter(F.col("event_id") % 4 == 0).withColumn("origin", F.lit("store"))
    even = ev.filter(F.col("event_id") % 2 == 0).withColumn("ts", F.when(F.col("event_id") % 6 != 0, F.col("ts")))
    batch = even.unionAll(even).withColumn("origin", F.lit("batch"))
    table = keyed.KeyedTable(spark, scratch_path(spark, "store"), store.schema, ["event_id"], 8)
    for rows, name in ((store, "first"), (batch, "second"), (batch, "second")):
        table.append_new(rows, name, "ts", at("2024-02-01 00:00:00"))
    return table.read().withColumn("ts", fx.plain("ts"))


@query("upsert_latest", """SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'changed' ELSE c_name END AS c_name, CASE c_custkey % 5 WHEN 1 THEN 2 ELSE 1 END AS rev FROM customer
    UNION ALL SELECT c_custkey + 10000000, 'added', 1 FROM customer WHERE c_custkey % 7 = 0""")
def upsert_latest(spark, d):
    """Three batches into a keyed table, the second one twice."""
    k = F.col("c_custkey")
    store = fx.table(spark, d, "customer").select("c_custkey", "c_name", F.lit(1).alias("rev"))
    changed = store.filter(k % 5 == 1).select(k, F.lit("changed").alias("c_name"), F.lit(2).alias("rev"))
    old = store.filter(k % 5 == 2).select(k, F.lit("stale").alias("c_name"), F.lit(0).alias("rev"))
    added = store.filter(k % 7 == 0).select((k + 10_000_000).alias("c_custkey"), F.lit("added").alias("c_name"), F.lit(1).alias("rev"))
    table = keyed.KeyedTable(spark, scratch_path(spark, "upserts"), store.schema, ["c_custkey"], 8)
    for rows, name in ((store, "a"), (changed.unionAll(old), "b"), (changed.unionAll(old), "b"), (added, "c")):
        table.upsert(rows, name, "rev")
    return table.read()


@query("upsert_stream", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def upsert_stream(spark, d):
    """The newest event of each user, kept up to date by a stream of three files."""
    ev = fx.table(spark, d, "events").select("user_id", "event_id", "ts")
    source = scratch_path(spark, "updates")
    ev.repartition(3, "event_id").write.parquet(source)
    table = keyed.KeyedTable(spark, scratch_path(spark, "newest"), ev.schema, ["user_id"], 8)
    live = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(source)
    table.upsert_stream(live, "ts", scratch_path(spark, "newest-checkpoint")).awaitTermination()
    return table.read().withColumn("ts", fx.plain("ts"))


@query("retention_trim", """SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS removed, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS kept,
    CAST(count(DISTINCT CAST(ts AS DATE)) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS INTEGER) AS days_kept,
    CAST(count(DISTINCT CAST(ts AS DATE)) FILTER (ts < TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS INTEGER) AS days_removed, count(*) FILTER (ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY) AS left_rows FROM events""")
def retention_trim(spark, d):
    """A table by day loses the folders of its old days; what is left is read again."""
    path = scratch_path(spark, "trim")
    fx.table(spark, d, "events").withColumn("day", F.to_date("ts")).repartition("day").write.partitionBy("day").parquet(path)
    row = keyed.trim_days(spark, path, keyed.RETENTION_DAYS["scaling_summary"], "2024-01-30")
    return beside(row, spark.read.parquet(path).agg(F.count(F.lit(1)).alias("left_rows")))


@query("summary_points", """WITH p AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY name) AS n FROM metric_points
    WHERE floor(epoch(ts)) <= epoch(TIMESTAMP '2024-01-20') AND floor(epoch(ts)) > epoch(TIMESTAMP '2024-01-20') - 21600)
    SELECT 'latency_summary' AS measurement, name AS queue, TIMESTAMP '2024-01-20' AS time, round(avg(value), 6) AS mean, max(CASE WHEN rn = floor(0.95::DOUBLE * (n - 1)) THEN value END) AS p95, count(*) AS count FROM p GROUP BY name""",
       ("metric_points",))
def summary_points(spark, d):
    snap = ag.window_snapshot(fx.metric_points(spark, d), [21600], at(T0))
    return sinks.summary_points(snap, "latency_summary", fx.plain(at(T0)))
