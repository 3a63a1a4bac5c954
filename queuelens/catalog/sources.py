"""Queries of section 2.1."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuelens import fixtures as fx
from queuelens.catalog.aggregates import T0, at
from queuelens.catalog.registry import query
from queuelens.session import scratch_path
from queuelens.sources import scan, sinks


def orders_schema(spark, d):
    return fx.table(spark, d, "orders").schema


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query("scan_csv", "SELECT * FROM lineitem")
def scan_csv(spark, d):
    li = fx.table(spark, d, "lineitem")
    path = scratch_path(spark, "csv")
    sinks.write_rows(li, path, "csv")
    return scan.scan_csv(spark, path, li.schema).withColumn("l_shipdate", fx.plain("l_shipdate"))


@query("scan_jsonl", "SELECT * FROM events")
def scan_jsonl(spark, d):
    ev = fx.table(spark, d, "events")
    path = scratch_path(spark, "jsonl")
    line = F.to_json(F.struct("*"), {"timestampFormat": sinks.JSON_TIME})
    broken = ev.filter(F.col("event_id") % 9 == 0).select(F.concat(F.substring(line, 1, 20), F.lit("...")))
    ev.select(line.alias("value")).unionAll(broken).write.text(path)
    return scan.scan_jsonl(spark, path, ev.schema).withColumn("ts", fx.plain("ts"))


@query("scan_table_auto", ORDERS)
def scan_table_auto(spark, d):
    o = fx.table(spark, d, "orders")
    base = scratch_path(spark, "auto")
    part = lambda k: o.filter(F.col("o_orderkey") % 4 == k)
    sinks.write_rows(part(0), f"{base}/a.csv", "csv")
    part(1).write.option("header", True).option("sep", "\t").option("timestampFormat", sinks.JSON_TIME).csv(f"{base}/b.tsv")
    sinks.write_rows(part(2), f"{base}/c.jsonl", "jsonl", gzip=True)
    sinks.write_rows(part(3), f"{base}/d.parquet", "parquet")
    out = scan.scan_auto(spark, [f"{base}/{n}" for n in ("a.csv", "b.tsv", "c.jsonl", "d.parquet")], o.schema)
    return out.withColumn("o_orderdate", fx.plain("o_orderdate"))


@query("scan_trace", """WITH h AS (SELECT row_number() OVER (ORDER BY date_trunc('hour', ts)) - 1 AS i, count(*) AS n, count(*) OVER () AS t FROM events GROUP BY date_trunc('hour', ts))
    SELECT step, h.n AS count FROM range(0, 1000) r(step) JOIN h ON h.i = step % h.t""")
def scan_trace(spark, d):
    h = fx.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    n, hour = F.col("n").cast("string"), F.hour("h")
    json = lambda k: F.concat(F.lit('{"ts": 1, "' + k + '": '), n, F.lit("}"))
    line = (F.when(hour % 5 == 0, json("count")).when(hour % 5 == 1, json("cnt")).when(hour % 5 == 2, json("c"))
            .when(hour % 5 == 3, F.concat(F.unix_seconds("h").cast("string"), F.lit(","), n)).otherwise(n))
    path = scratch_path(spark, "trace")
    h.orderBy("h").select(line.alias("value")).write.text(path)
    return scan.scan_trace(spark, path, 1000)


@query("find_docs", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def find_docs(spark, d):
    return scan.find_docs(fx.table(spark, d, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000),
                          ["o_orderkey", "o_totalprice"], [F.desc("o_totalprice"), F.col("o_orderkey")], 100)


@query("page_by_ts", """SELECT event_id, ts, CAST((row_number() OVER (ORDER BY ts DESC, event_id) - 1) // 20 + 1 AS INTEGER) AS page FROM (
    SELECT event_id, date_trunc('hour', ts) AS ts FROM events) WHERE ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id LIMIT 60""")
def page_by_ts(spark, d):
    """Three pages of whole hours, many of them equal, each asked for with the token of the page before."""
    ev = fx.table(spark, d, "events").select("event_id", F.date_trunc("hour", "ts").alias("ts"))
    token, out = at(T0), None
    for n in range(1, 4):
        page = scan.page_by_ts(ev, token, 20, "ts", "event_id").withColumn("page", F.lit(n))
        out, token = (page if out is None else out.unionByName(page)), scan.next_token(page, "ts", "event_id")
    return out.withColumn("ts", fx.plain("ts"))


@query("tail_n", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def tail_n(spark, d):
    return scan.tail_n(fx.table(spark, d, "events").select("event_id", "ts"), 100, "ts", "event_id").withColumn("ts", fx.plain("ts"))


@query("file_manifest", """WITH f AS (SELECT CAST(o_custkey % 4 AS INTEGER) AS k, string_agg(o_orderkey || ' ' || o_orderpriority || chr(10), '' ORDER BY o_orderkey) AS t FROM orders GROUP BY 1),
    b AS (SELECT k, t, unnest(range(0, CAST(ceil(length(t) / 4096.0) AS BIGINT))) AS i FROM f), h AS (SELECT k, length(t) AS size, string_agg(sha256(substr(t, i * 4096 + 1, 4096)), '' ORDER BY i) AS h FROM b GROUP BY ALL)
    SELECT k, size, sha256(h) AS digest, size > 50000 AS in_blocks FROM h""")
def file_manifest(spark, d):
    """Four files of known text, some read whole and some in blocks, digests by the same rule."""
    path = scratch_path(spark, "files")
    fx.table(spark, d, "orders").select((F.col("o_custkey") % 4).cast("int").alias("k"), "o_orderkey", F.concat_ws(" ", "o_orderkey", "o_orderpriority").alias("value")).repartition(
        "k").sortWithinPartitions("k", "o_orderkey").select("k", "value").write.partitionBy("k").text(path)
    made = scan.file_manifest(spark, path, 4096, 50_000)
    return made.filter(F.col("path").endswith(".txt")).select(
        F.regexp_extract("path", "k=([0-9]+)", 1).cast("int").alias("k"), "size", "digest", (F.col("size") > 50_000).alias("in_blocks"))


@query("scan_log_json", """SELECT event_type AS service, CASE WHEN value > 90 THEN 'ERROR' WHEN value > 60 THEN 'WARN' ELSE 'INFO' END AS level, count(*) AS lines, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1, 2""")
def scan_log_json(spark, d):
    v = F.col("value")
    line = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"),
        F.when(v > 90, "ERROR").when(v > 60, "WARN").otherwise("INFO").alias("level"), F.lit("app").alias("logger"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), F.lit("m").alias("module"),
        F.col("event_type").alias("service"), F.col("user_id").cast("string").alias("trace_id"), F.lit("s").alias("span_id"),
        F.col("event_id").alias("line"), F.create_map(F.lit("value"), v.cast("string")).alias("extra"))
    path = scratch_path(spark, "logs")
    fx.table(spark, d, "events").select(F.to_json(line).alias("value")).write.text(path)
    return scan.log_levels(scan.scan_logs(spark, path))


@query("sample_ingest", "SELECT event_id, event_type, value FROM events WHERE ('0x' || substr(md5('7:' || event_id), 1, 8))::BIGINT % 1000000 < 250000")
def sample_ingest(spark, d):
    return scan.sample_rows(fx.table(spark, d, "events"), 0.25, "event_id", 7).select("event_id", "event_type", "value")
