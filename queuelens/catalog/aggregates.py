"""Queries of section 2.5."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuelens import fixtures as fx
from queuelens.catalog.registry import query
from queuelens.functions.columns import queue_key
from queuelens.operators import aggregates as ag
from queuelens.operators import experiments as ex
from queuelens.operators.aggregates import r6

T0 = "2024-01-20 00:00:00"


def at(text: str):
    return F.to_timestamp(F.lit(text))


@query("bucket_aggregate", """SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600) AT TIME ZONE 'UTC' AS window_start, name,
    count(*) AS count, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max
    FROM metric_points GROUP BY 1, 2""", ("metric_points",))
def bucket_aggregate(spark, d):
    out = ag.bucket_aggregate(fx.metric_points(spark, d), 3600)
    return out.withColumn("window_start", fx.plain("window_start"))


@query("rollup_series", """SELECT name, '{"k":"' || k || '","user":"' || user_id || '"}' AS labels, count(*) AS count,
    round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM metric_points
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY name, k, user_id""", ("metric_points",))
def rollup_series(spark, d):
    return ag.rollup_series(fx.metric_points(spark, d), at("2024-01-10 00:00:00"), at(T0))


@query("top_names", """SELECT name, count(*) AS count FROM metric_points WHERE ts >= TIMESTAMP '2024-01-10'
    GROUP BY name ORDER BY count DESC, name LIMIT 3""", ("metric_points",))
def top_names(spark, d):
    return ag.top_names(fx.metric_points(spark, d), at("2024-01-10 00:00:00"), 3)


@query("usage_totals", """SELECT customer_id, metric, CAST(sum(quantity) AS BIGINT) AS total FROM usage
    WHERE ts >= TIMESTAMP '1997-01-01' GROUP BY 1, 2""", ("usage",))
def usage_totals(spark, d):
    return ag.usage_totals(fx.usage(spark, d), at("1997-01-01 00:00:00"))


@query("invoice_totals", """SELECT invoice_id, s AS subtotal_cents, t AS tax_cents, s + t AS total_cents FROM (
    SELECT invoice_id, s, CAST(ceil(CAST(s AS DECIMAL(20,0)) * 8.25 / 100) AS BIGINT) AS t FROM (
    SELECT invoice_id, CAST(sum(amount_cents * quantity) AS BIGINT) AS s FROM invoice_lines GROUP BY 1))""",
       ("invoice_lines",))
def invoice_totals(spark, d):
    return ag.invoice_totals(fx.invoice_lines(spark, d), "8.25")


@query("dunning_list", """SELECT invoice_id, customer_id, total_cents, CAST(invoice_id % 4 AS INTEGER) AS attempts,
    CASE invoice_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 48 ELSE 96 END AS retry_hours,
    TIMESTAMP '1998-01-01' + to_hours(CASE invoice_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 48 ELSE 96 END) AS next_retry
    FROM invoices WHERE NOT paid AND created_at <= TIMESTAMP '1997-12-31'""", ("invoices",))
def dunning_list(spark, d):
    out = ag.dunning_list(fx.invoices(spark, d), F.col("invoice_id") % 4, at("1998-01-01 00:00:00"))
    return out.withColumn("next_retry", fx.plain("next_retry"))


@query("scaling_summary", """SELECT count(*) AS count, round(avg("to"), 6) AS avg_to, max("to") AS max_to,
    min("to") AS min_to, count(*) FILTER (action = 'scale_up') AS up, count(*) FILTER (action = 'scale_down') AS down,
    round(count(*) FILTER (action = 'scale_up') / count(*), 6) AS up_ratio,
    round(count(*) FILTER (action = 'scale_down') / count(*), 6) AS down_ratio,
    round(count(*) FILTER (action = 'steady') / count(*), 6) AS steady_ratio, round(avg(score), 6) AS mean_score
    FROM scaling_actions WHERE ts BETWEEN TIMESTAMP '2024-01-18' AND TIMESTAMP '2024-01-20'""", ("scaling_actions",))
def scaling_summary(spark, d):
    return ag.scaling_summary(fx.scaling_actions(spark, d), 48, at(T0))


@query("drift_event_stats", """SELECT feature, count(*) AS count, round(avg(v), 6) AS mean, max(v) AS max FROM (
    SELECT ts, 'value' AS feature, value / 100 AS v FROM metric_points
    UNION ALL SELECT ts, 'k_' || (k % 12), k / 100.0::DOUBLE FROM metric_points)
    WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1 ORDER BY mean DESC, feature LIMIT 10""", ("metric_points",))
def drift_event_stats(spark, d):
    k = F.col("labels")["k"].cast("int")
    per = F.create_map(F.lit("value"), F.col("value") / 100, F.concat(F.lit("k_"), (k % 12).cast("string")), k / 100.0)
    events = fx.metric_points(spark, d).select("ts", F.col("key").alias("event_id"), per.alias("per_feature"))
    return ag.drift_event_stats(events, at("2024-01-05 00:00:00"))


@query("queue_depth", """SELECT concat_ws(':', 'queue', tenant, task_type) AS queue_key,
    count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'reserved') AS in_flight,
    count(*) FILTER (status = 'dead') AS dlq, count(*) AS total FROM tasks GROUP BY 1""", ("tasks",))
def queue_depth(spark, d):
    return ag.queue_depth(fx.tasks(spark, d), queue_key("tenant", "task_type"))


@query("throughput", """SELECT count(*) FILTER (event = 'ack') AS acks,
    round(count(*) FILTER (event = 'ack') / 1440.0::DOUBLE, 2) AS per_minute FROM task_history
    WHERE ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20'""", ("task_history",))
def throughput(spark, d):
    return ag.throughput(fx.task_history(spark, d), 24, at(T0))


@query("failure_rate", """SELECT f AS failures, a AS acks, CASE WHEN a = 0 THEN 0.0::DOUBLE ELSE round(100.0::DOUBLE * f / a, 2) END AS failure_pct,
    CASE WHEN a + f = 0 THEN 0.0::DOUBLE ELSE round(100.0::DOUBLE * f / (a + f), 2) END AS failure_share_pct FROM (
    SELECT count(*) FILTER (event = 'fail') AS f, count(*) FILTER (event = 'ack') AS a FROM task_history
    WHERE ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20')""", ("task_history",))
def failure_rate(spark, d):
    return ag.failure_rate(fx.task_history(spark, d), 24, at(T0))


@query("status_summary", """SELECT s.status, count(t.task_id) AS count FROM (VALUES ('pending'), ('reserved'),
    ('completed'), ('failed'), ('dead'), ('cancelled')) s(status) LEFT JOIN tasks t ON t.status = s.status GROUP BY 1""",
       ("tasks",))
def status_summary(spark, d):
    return ag.status_summary(fx.tasks(spark, d))


SNAP = """WITH w AS (SELECT unnest([60, 300, 900, 3600, 86400]) AS window_s), p AS (
    SELECT name, window_s, value, row_number() OVER (PARTITION BY name, window_s ORDER BY value) - 1 AS rn,
    count(*) OVER (PARTITION BY name, window_s) AS n FROM metric_points, w
    WHERE floor(epoch(ts)) <= epoch(TIMESTAMP '2024-01-20') AND floor(epoch(ts)) > epoch(TIMESTAMP '2024-01-20') - window_s)
    SELECT name, window_s, count(*) AS count, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean,
    max(CASE WHEN rn = floor(0.5::DOUBLE * (n - 1)) THEN value END) AS p50,
    max(CASE WHEN rn = floor(0.95::DOUBLE * (n - 1)) THEN value END) AS p95, min(value) AS min, max(value) AS max
    FROM p GROUP BY 1, 2"""


@query("window_snapshot", SNAP, ("metric_points",))
def window_snapshot(spark, d):
    return ag.window_snapshot(fx.metric_points(spark, d), [60, 300, 900, 3600, 86400], at(T0))


@query("histogram", """SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin,
    count(*) AS count FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1""")
def histogram(spark, d):
    return ag.histogram(fx.table(spark, d, "lineitem"), "l_extendedprice", 50)


@query("latency_heatmap", """SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600) AT TIME ZONE 'UTC' AS slot,
    CAST(greatest(0, least(49, floor((1.0::DOUBLE - exp(-value / (1.0::DOUBLE + value))) * 49))) AS INTEGER) AS bin,
    count(*) AS count FROM metric_points GROUP BY 1, 2""", ("metric_points",))
def latency_heatmap(spark, d):
    return ag.latency_heatmap(fx.metric_points(spark, d), 3600).withColumn("slot", fx.plain("slot"))


@query("latency_heatmap_scaled", """SELECT to_timestamp(floor(epoch(ts) / 5) * 5) AT TIME ZONE 'UTC' AS slot,
    CAST(greatest(0, least(49, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 200)) * 49))) AS INTEGER) AS bin,
    count(*) AS count FROM metric_points GROUP BY 1, 2""", ("metric_points",))
def latency_heatmap_scaled(spark, d):
    return ag.latency_heatmap(fx.metric_points(spark, d), 5, 50, 200.0).withColumn("slot", fx.plain("slot"))


@query("recent_stats", """WITH p AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS rn,
    count(*) OVER (PARTITION BY name) AS n FROM metric_points
    WHERE ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20')
    SELECT name, count(*) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
    max(CASE WHEN rn = greatest(floor(n * 0.9::DOUBLE) - 1, 0) THEN value END) AS p90 FROM p GROUP BY 1""", ("metric_points",))
def recent_stats(spark, d):
    return ag.recent_stats(fx.metric_points(spark, d), 86400, at(T0))


@query("regression_metrics", """SELECT round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse,
    round(1 - avg(e * e) / var_pop(y), 6) AS r2, round(quantile_cont(abs(e), 0.95), 6) AS p95_abs_err, count(*) AS n
    FROM (SELECT y, y - g AS e FROM (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5::DOUBLE AS g FROM lineitem))""")
def regression_metrics(spark, d):
    li = fx.table(spark, d, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("g"))
    return ag.regression_metrics(li, "y", "g")


def halves(spark, d):
    li = fx.table(spark, d, "lineitem")
    return li.filter(F.col("l_orderkey") % 2 == 0), li.filter(F.col("l_orderkey") % 2 == 1)


NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
CAT = ("l_returnflag", "l_linestatus")
NUM_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS feature, abs(avg({c}) FILTER (l_orderkey % 2 = 1)
    - avg({c}) FILTER (l_orderkey % 2 = 0)) / stddev_samp({c}) FILTER (l_orderkey % 2 = 0) AS score FROM lineitem""" for c in NUM)
CAT_SQL = " UNION ALL ".join(f"""SELECT '{c}' AS feature, 0.5::DOUBLE * sum(CASE WHEN a > 0 THEN a * ln(a / m + 1e-12::DOUBLE) ELSE 0 END)
    + 0.5::DOUBLE * sum(CASE WHEN b > 0 THEN b * ln(b / m + 1e-12::DOUBLE) ELSE 0 END) AS score FROM (
    SELECT a, b, 0.5::DOUBLE * (a + b) AS m FROM (SELECT {c},
        count(*) FILTER (l_orderkey % 2 = 0) / (SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = 0) AS a,
        count(*) FILTER (l_orderkey % 2 = 1) / (SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = 1) AS b
        FROM lineitem GROUP BY {c}))""" for c in CAT)


@query("numeric_drift", f"SELECT feature, round(score, 6) AS score FROM ({NUM_SQL})")
def numeric_drift(spark, d):
    ref, new = halves(spark, d)
    return ag.numeric_drift(ref, new, NUM).withColumn("score", r6("score"))


@query("categorical_drift", f"SELECT feature, round(score, 9) AS score FROM ({CAT_SQL})")
def categorical_drift(spark, d):
    ref, new = halves(spark, d)
    return ag.categorical_drift(ref, new, CAT).withColumn("score", F.round("score", 9))


@query("dataset_drift", f"""WITH s AS ({NUM_SQL} UNION ALL {CAT_SQL})
    SELECT round(avg(score), 6) AS aggregate, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (score >= 0.005), '') AS flagged,
    string_agg(feature || ':' || printf('%.6f', round(score, 6)), ',' ORDER BY feature) AS per_feature,
    (SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = 0) AS ref_rows,
    (SELECT count(*) FROM lineitem WHERE l_orderkey % 2 = 1) AS new_rows FROM s""")
def dataset_drift(spark, d):
    ref, new = (h.select(*NUM, *CAT) for h in halves(spark, d))
    out = ag.dataset_drift(ref, new, 0.005)
    scores = F.array_sort(F.map_entries(F.from_json("per_feature", "map<string,double>")))
    return out.withColumn("per_feature", F.array_join(F.transform(scores, lambda e: F.concat(e["key"], F.lit(":"), F.format_string("%.6f", e["value"]))), ","))


SIDE = """(SELECT avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS p50,
    quantile_cont(value, 0.95) AS p95 FROM events WHERE ts {op} TIMESTAMP '2024-01-16')"""


@query("distribution_drift", f"""SELECT round(greatest(md, sd), 6) AS drift_score, greatest(md, sd) > 0.3 AS drift_detected,
    round(md, 6) AS mean_drift, round(sd, 6) AS std_drift, round(abs(c.p50 - r.p50) / (abs(r.p50) + 1e-8), 6) AS p50_shift,
    round(abs(c.p95 - r.p95) / (abs(r.p95) + 1e-8), 6) AS p95_shift, round(r.mean, 6) AS ref_mean, round(r.std, 6) AS ref_std,
    round(r.p50, 6) AS ref_p50, round(r.p95, 6) AS ref_p95, round(c.mean, 6) AS cur_mean, round(c.std, 6) AS cur_std,
    round(c.p50, 6) AS cur_p50, round(c.p95, 6) AS cur_p95
    FROM {SIDE.format(op='<')} r, {SIDE.format(op='>=')} c,
    LATERAL (SELECT abs(c.mean - r.mean) / (r.std + 1e-8) AS md, abs(c.std - r.std) / (r.std + 1e-8) AS sd)""")
def distribution_drift(spark, d):
    ev = fx.table(spark, d, "events")
    cut = at("2024-01-16 00:00:00")
    return ag.distribution_drift(ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut), "value")


@query("distribution_drift_arrays", """SELECT CAST(i - 1 AS INTEGER) AS dim, label, round(avg(v), 6) AS mean,
    round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM (
    SELECT label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)) GROUP BY 1, 2""")
def distribution_drift_arrays(spark, d):
    return ag.array_dimension_stats(fx.table(spark, d, "embeddings"), "embedding", ["label"])


@query("episode_summary", """WITH e AS (SELECT run_id, round(sum(reward), 6) AS reward, count(*) AS length,
    bool_or(run_id % 17 = 3) AS failed FROM run_log GROUP BY 1), d AS (SELECT *, row_number() OVER (ORDER BY reward) - 1 AS rn,
    count(*) OVER () AS n FROM e WHERE NOT failed)
    SELECT (SELECT count(*) FROM e) AS requested, count(*) AS completed, (SELECT count(*) FROM e) - count(*) AS failed,
    round(avg(reward), 6) AS reward_mean, round(stddev_pop(reward), 6) AS reward_std, min(reward) AS reward_min,
    max(reward) AS reward_max, max(CASE WHEN rn = floor(0.5::DOUBLE * n) THEN reward END) AS reward_p50,
    max(CASE WHEN rn = floor(0.95::DOUBLE * n) THEN reward END) AS reward_p95, round(avg(length), 6) AS mean_episode_length FROM d""",
       ("run_log",))
def episode_summary(spark, d):
    steps = fx.run_log(spark, d).select(F.col("run_id").alias("episode"), "reward",
                                        (F.col("run_id") % 17 == 3).alias("failed"))
    return ag.episode_summary(steps)


@query("run_step_summary", """SELECT run_id, max_by(t * 3, t) AS total_processed, max_by(t // 2, t) AS total_failed,
    round(avg(reward), 6) AS avg_backlog FROM run_log GROUP BY 1""", ("run_log",))
def run_step_summary(spark, d):
    return ag.run_step_summary(fx.run_log(spark, d).select(
        "run_id", "t", (F.col("t") * 3).alias("processed_cumulative"),
        F.floor(F.col("t") / 2).alias("failed_cumulative"), F.col("reward").alias("backlog")))


@query("timing_summary", """SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
    round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
    round(quantile_cont(value, 0.99), 6) AS p99, round(32.0::DOUBLE / avg(value), 6) AS rate, count(value) AS n
    FROM events GROUP BY 1""")
def timing_summary(spark, d):
    return ag.timing_summary(fx.table(spark, d, "events"), "event_type", "value", F.lit(32.0))


@query("zscore_columns", """SELECT l_orderkey, l_linenumber, round((l_quantity - qm) / qs, 6) AS l_quantity,
    round((l_extendedprice - pm) / ps, 6) AS l_extendedprice FROM lineitem, (SELECT
    0.9::DOUBLE * avg(l_quantity) FILTER (l_orderkey % 2 = 0) + (1 - 0.9::DOUBLE) * avg(l_quantity) FILTER (l_orderkey % 2 = 1) AS qm,
    0.9::DOUBLE * stddev_samp(l_quantity) FILTER (l_orderkey % 2 = 0) + (1 - 0.9::DOUBLE) * stddev_samp(l_quantity) FILTER (l_orderkey % 2 = 1) AS qs,
    0.9::DOUBLE * avg(l_extendedprice) FILTER (l_orderkey % 2 = 0) + (1 - 0.9::DOUBLE) * avg(l_extendedprice) FILTER (l_orderkey % 2 = 1) AS pm,
    0.9::DOUBLE * stddev_samp(l_extendedprice) FILTER (l_orderkey % 2 = 0) + (1 - 0.9::DOUBLE) * stddev_samp(l_extendedprice) FILTER (l_orderkey % 2 = 1) AS ps
    FROM lineitem)""")
def zscore_columns(spark, d):
    cols = ["l_quantity", "l_extendedprice"]
    ref, new = halves(spark, d)
    scaler = ag.blend_scaler(ag.fit_scaler(ref, cols), ag.fit_scaler(new, cols))
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    return ag.zscore_columns(li, scaler, cols).select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in cols])


@query("scaling_drift", """WITH a AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn,
    CAST(event_id % 13 AS DOUBLE) AS b, score * 2 AS c FROM scaling_actions)
    SELECT round(avg(score) FILTER (rn <= 200), 6) AS avg_score, round(stddev_pop(score) FILTER (rn <= 200), 6) AS stdev,
    (stddev_pop(score) FILTER (rn <= 200) > 0.8 OR abs(avg(score) FILTER (rn <= 200)) > 1.0) AS drift,
    round(avg((b - c) / greatest(1.0::DOUBLE, abs(b))) FILTER (rn <= 100 AND b <> 0 AND c <> 0), 6) AS avg_improvement FROM a""",
       ("scaling_actions",))
def scaling_drift(spark, d):
    actions = fx.scaling_actions(spark, d).select(
        "event_id", "ts", "score", (F.col("event_id") % 13).cast("double").alias("before"),
        (F.col("score") * 2).alias("after"))
    return ag.scaling_drift(actions)


@query("run_cost", """SELECT o_orderstatus, count(*) AS runs, round(count(*) * 0.01::DOUBLE, 2) AS cost FROM orders GROUP BY 1""")
def run_cost(spark, d):
    return ag.run_cost(fx.table(spark, d, "orders"), ["o_orderstatus"])


@query("folder_hash", """WITH a AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS folder, substr(sha256(url), 1, 6) AS part, sha256(string_agg(url || ':' || sha256(html), chr(10) ORDER BY url || ':' || sha256(html))) AS h, count(*) AS n
    FROM pages GROUP BY 1, 2), b AS (SELECT folder, substr(part, 1, 3) AS part, sha256(string_agg(part || ':' || h, chr(10) ORDER BY part || ':' || h)) AS h, sum(n) AS n FROM a GROUP BY 1, 2)
    SELECT folder, sha256(string_agg(part || ':' || h, chr(10) ORDER BY part || ':' || h)) AS digest, CAST(sum(n) AS BIGINT) AS files FROM b GROUP BY 1""")
def folder_hash(spark, d):
    pages = fx.table(spark, d, "pages").select(
        F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))
    host = F.regexp_extract("path", r"^[a-z]+://([^/]+)", 1)
    return ag.folder_hash(pages, host)


@query("approx_counts", """SELECT count(*) AS points, count(*) FILTER (name LIKE '%i%') AS matching, count(DISTINCT name) AS names
    FROM metric_points""", ("metric_points",))
def approx_counts(spark, d):
    return ag.approx_counts(fx.metric_points(spark, d), "*i*")


RUN_LOG_SQL = """l AS (SELECT run_id, node || (t // 2) AS node, t, reward FROM run_log), a AS (
    SELECT run_id, node, t AS moment, 'node_start' AS action, NULL::INTEGER AS attempts, NULL::BOOLEAN AS success FROM l
    UNION ALL SELECT run_id, node, t + reward, 'node_end', CAST(1 + t % 3 AS INTEGER), t <> 5 FROM l WHERE t <> 6),
    n AS (SELECT run_id, node, min(CASE WHEN action = 'node_start' THEN moment END) AS started,
    max(CASE WHEN action = 'node_end' THEN moment END) AS ended, max(CASE WHEN action = 'node_end' THEN attempts END) AS attempts,
    bool_and(CASE WHEN action = 'node_end' THEN success END) AS success FROM a GROUP BY 1, 2)"""


def workflow_log(spark, d):
    log = fx.run_log(spark, d).withColumn("node", F.concat("node", F.floor(F.col("t") / 2).cast("string")))
    start = log.select("run_id", "node", F.col("t").cast("double").alias("moment"), F.lit("node_start").alias("action"),
                       F.lit(None).cast("int").alias("attempts"), F.lit(None).cast("boolean").alias("success"))
    end = log.filter(F.col("t") != 6).select(
        "run_id", "node", F.col("t") + F.col("reward"), F.lit("node_end"), (1 + F.col("t") % 3).cast("int"),
        F.col("t") != 5)
    return start.unionAll(end)


@query("trace_timeline", f"""WITH {RUN_LOG_SQL} SELECT run_id, node, round(started, 6) AS started, round(ended, 6) AS ended,
    attempts, success FROM n""", ("run_log",))
def trace_timeline(spark, d):
    return ag.trace_timeline(workflow_log(spark, d)).withColumns({"started": r6("started"), "ended": r6("ended")})


@query("trace_run_status", f"""WITH {RUN_LOG_SQL} SELECT run_id, CASE WHEN bool_and(success) THEN 'completed' ELSE 'failed' END AS status,
    count(*) AS nodes, round(sum(ended - started), 6) AS duration FROM n WHERE ended IS NOT NULL GROUP BY 1""", ("run_log",))
def trace_run_status(spark, d):
    return ag.run_status(ag.trace_timeline(workflow_log(spark, d)))


@query("worker_type_stats", """SELECT worker_type, count(*) AS total, count(*) FILTER (status = 'running') AS running,
    count(*) FILTER (status = 'crashed') AS crashed, count(*) FILTER (status = 'stopped') AS stopped,
    round(avg(epoch(TIMESTAMP '2024-01-20') - epoch(started_at)) FILTER (status = 'running'), 6) AS mean_uptime_s
    FROM workers GROUP BY 1""", ("workers",))
def worker_type_stats(spark, d):
    return ag.worker_type_stats(fx.workers(spark, d), at(T0))


@query("backlog_per_worker", """SELECT q.task_type, q.backlog, coalesce(w.running, 0) AS running,
    round(q.backlog / greatest(1, coalesce(w.running, 0)), 6) AS backlog_per_worker FROM (
    SELECT task_type, count(*) AS backlog FROM tasks WHERE status = 'pending' GROUP BY 1) q LEFT JOIN (
    SELECT replace(worker_type, 'w', 'type_') AS task_type, count(*) FILTER (status = 'running') AS running
    FROM workers GROUP BY 1) w ON q.task_type = w.task_type""", ("tasks", "workers"))
def backlog_per_worker(spark, d):
    depth = fx.tasks(spark, d).filter(F.col("status") == "pending").groupBy("task_type").agg(
        F.count(F.lit(1)).alias("backlog"))
    running = ag.worker_type_stats(fx.workers(spark, d), at(T0)).select(
        F.regexp_replace("worker_type", "w", "type_").alias("task_type"), "running")
    return ag.backlog_per_worker(depth, running, "task_type")


@query("health_rollup", """WITH c AS (SELECT s_nationkey AS grp, s_suppkey AS pos,
    CASE s_suppkey % 4 WHEN 2 THEN 'warn' WHEN 3 THEN 'fail' ELSE 'ok' END AS status FROM supplier)
    SELECT grp, CASE WHEN count(*) FILTER (status <> 'ok') = 0 THEN 'ok'
    WHEN arg_min(status, pos) FILTER (status <> 'ok') = 'warn' THEN 'degraded' ELSE 'fail' END AS overall,
    count(*) FILTER (status <> 'ok') AS not_ok, count(*) AS components FROM c GROUP BY 1""")
def health_rollup(spark, d):
    s = F.col("s_suppkey") % 4
    checks = fx.table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("pos"),
        F.when(s == 2, "warn").when(s == 3, "fail").otherwise("ok").alias("status"))
    return ag.health_rollup(checks, ["grp"])


AB = """WITH v AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS arm, CASE WHEN user_id % 2 = 0 THEN value ELSE value * 1.1::DOUBLE END AS x FROM events), m AS (
    SELECT count(*) FILTER (arm = 'a') AS n_a, count(*) FILTER (arm = 'b') AS n_b, avg(x) FILTER (arm = 'a') AS mean_a, avg(x) FILTER (arm = 'b') AS mean_b, var_pop(x) FILTER (arm = 'a') AS var_a, var_pop(x) FILTER (arm = 'b') AS var_b FROM v),
    c AS (SELECT x, count(*)::DOUBLE AS c, count(*) FILTER (arm = 'b') AS cb FROM v GROUP BY 1), r AS (SELECT *, sum(c) OVER (ORDER BY x) - c + (c + 1) / 2 AS rk FROM c),
    u AS (SELECT sum(cb * rk) - any_value(m.n_b) * (any_value(m.n_b) + 1) / 2 AS u_b, sum(c * c * c - c) AS tt FROM r, m)
    SELECT n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round((mean_b - mean_a) / abs(mean_a) * 100, 6) AS improvement_pct,
    round((mean_b - mean_a) / sqrt((n_a * var_a + n_b * var_b) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)), 6) AS t, n_a + n_b - 2 AS dof, round((mean_b - mean_a) / sqrt((var_a + var_b) / 2), 6) AS effect_size, u_b,
    round((abs(u_b - n_a * n_b / 2) - 0.5) / sqrt(n_a * n_b / 12 * (n_a + n_b + 1 - tt / ((n_a + n_b) * (n_a + n_b - 1)))), 6) AS z FROM m, u"""


def arms(spark, d):
    ev = fx.table(spark, d, "events")
    even = F.col("user_id") % 2 == 0
    return ev.select("event_id", F.when(even, "a").otherwise("b").alias("arm"), F.when(even, F.col("value")).otherwise(F.col("value") * 1.1).alias("x"))


@query("ab_statistics", AB)
def ab_statistics(spark, d):
    out = ex.ab_statistics(arms(spark, d), "arm", "x")
    return out.withColumns({c: r6(c) for c in ("mean_a", "mean_b", "improvement_pct", "t", "effect_size", "z")})


@query("ab_compare", f"""SELECT n_a, n_b, improvement_pct, t, abs(t) > 1.96 AS significant, CASE WHEN abs(t) <= 1.96 THEN 'inconclusive' WHEN improvement_pct > 5 THEN 'deploy' WHEN improvement_pct < -5 THEN 'reject' ELSE 'neutral' END AS recommendation,
    true AS ci_covers, true AS ci_width_fits, true AS p_fits FROM ({AB})""")
def ab_compare(spark, d):
    """The bootstrap interval is checked against the normal one, the p-value against the critical t of many rows."""
    out = ex.ab_compare(arms(spark, d), "arm", "x", "event_id")
    diff, width = F.col("mean_b") - F.col("mean_a"), F.col("ci_high") - F.col("ci_low")
    normal = 2 * 1.959964 * F.abs(diff / F.col("t"))
    return out.select("n_a", "n_b", r6("improvement_pct").alias("improvement_pct"), r6("t").alias("t"), "significant", "recommendation",
                      ((F.col("ci_low") < diff) & (diff < F.col("ci_high"))).alias("ci_covers"), (F.abs(width / normal - 1) < 0.25).alias("ci_width_fits"),
                      ((F.col("p_value") < 0.05) == (F.abs("t") > 1.96)).alias("p_fits"))
