"""Queries of section 2.6."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuelens import fixtures as fx
from queuelens.catalog.aggregates import T0, at
from queuelens.catalog.registry import query
from queuelens.functions.columns import queue_key
from queuelens.operators import aggregates as ag
from queuelens.operators import ordered as od
from queuelens.operators.aggregates import r6


def events(spark, d):
    return fx.table(spark, d, "events")


def _roll_sql(w):
    f = f"(PARTITION BY task_type ORDER BY epoch_us(\"timestamp\") RANGE BETWEEN {w * 1_000_000 - 1} PRECEDING AND CURRENT ROW)"
    return ", ".join([f"round(avg(duration_ms) OVER {f}, 6) AS dur_mean_{w}", f"round(coalesce(stddev_samp(duration_ms) OVER {f}, 0), 6) AS dur_std_{w}",
                      f"count(duration_ms) OVER {f} AS dur_count_{w}", f"round(avg(queue_length) OVER {f}, 6) AS queue_mean_{w}",
                      f"round(coalesce(stddev_samp(queue_length) OVER {f}, 0), 6) AS queue_std_{w}"])


@query("rolling_features", f"SELECT task_id, {_roll_sql(300)}, {_roll_sql(21600)} FROM telemetry", ("telemetry",))
def rolling_features(spark, d):
    out = od.rolling_features(fx.telemetry(spark, d), ["task_type"], (300, 21600))
    cols = [c for c in out.columns if c.startswith(("dur_", "queue_")) and c.rsplit("_", 1)[1].isdigit()]
    return out.select("task_id", *[c if "count" in c else r6(c).alias(c) for c in cols])


BUCKET_SQL = "CAST(greatest(ceil((row_number() OVER (ORDER BY {v}, {t}) - 1) * 5 / (count(*) OVER () - 1)) - 1, 0) AS INTEGER)"


@query("latency_bucket_label", f"SELECT task_id, {BUCKET_SQL.format(v='duration_ms', t='task_id')} AS label FROM telemetry", ("telemetry",))
def latency_bucket_label(spark, d):
    return od.latency_bucket(fx.telemetry(spark, d).select("task_id", "duration_ms"), "duration_ms", "task_id", 5, "label").select("task_id", "label")


@query("next_value_label", f"""WITH n AS (SELECT conv_id, turn, conv_id * 100 + turn AS id, coalesce(lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), length(text)) AS next_value FROM conversations)
    SELECT conv_id, turn, CAST(next_value AS INTEGER) AS next_value, {BUCKET_SQL.format(v='next_value', t='id')} AS label FROM n""")
def next_value_label(spark, d):
    c = fx.table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.length("text").alias("size"))
    out = od.next_value_label(c, "conv_id", ["turn"], "size", "id")
    return out.select("conv_id", "turn", "next_value", "label")


@query("fail_label", "SELECT task_id, 1 - success AS label FROM telemetry", ("telemetry",))
def fail_label(spark, d):
    return od.fail_label(fx.telemetry(spark, d)).select("task_id", "label")


@query("latest_per_key", """SELECT user_id, event_id, event_type FROM events WHERE value > 1
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts DESC, event_id DESC) = 1""")
def latest_per_key(spark, d):
    return od.latest_per_key(events(spark, d), "user_id", ["ts", "event_id"], F.col("value") > 1,
                             [F.col("event_type") == "purchase"]).select("user_id", "event_id", "event_type")


@query("latest_model", """SELECT model_type, version_id FROM model_runs QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY active DESC, score >= 70 DESC, name = 'red widget' DESC, created_at DESC, version_id DESC) = 1""", ("model_runs",))
def latest_model(spark, d):
    return od.latest_per_key(fx.model_runs(spark, d), "model_type", ["created_at", "version_id"], None, [
        F.col("active"), F.col("score") >= 70, F.col("name") == "red widget"]).select("model_type", "version_id")


VER = "SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version FROM events"


def history(spark, d):
    return od.version_history(events(spark, d).select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"],
                              ["ts", "event_id"])


@query("version_history", f"SELECT user_id, event_type, event_id, version FROM ({VER})")
def version_history(spark, d):
    return history(spark, d).select("user_id", "event_type", "event_id", "version")


@query("version_rollback", f"""WITH v AS ({VER}) SELECT user_id, event_type, event_id, version, ts FROM v UNION ALL
    SELECT user_id, event_type, event_id, (SELECT max(version) FROM v w WHERE w.user_id = v.user_id AND w.event_type = v.event_type) + 1, TIMESTAMP '2024-02-01' FROM v WHERE version = 2""")
def version_rollback(spark, d):
    out = od.rollback(history(spark, d), ["user_id", "event_type"], 2, at("2024-02-01 00:00:00"))
    return out.select("user_id", "event_type", "event_id", "version", fx.plain("ts").alias("ts"))


@query("version_nth_previous", """SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 3""")
def version_nth_previous(spark, d):
    return od.nth_previous(history(spark, d), ["user_id", "event_type"], 2).select("user_id", "event_type", "event_id")


@query("keep_last_n", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 7")
def keep_last_n(spark, d):
    return od.keep_last_n(events(spark, d), 7, ["ts", "event_id"], ["user_id"]).select("event_id", "user_id")


@query("keep_last_many", "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1500")
def keep_last_many(spark, d):
    return od.keep_last_n(events(spark, d), 1500, ["ts", "event_id"], ["event_type"]).select("event_id", "event_type")


HOURLY = "SELECT event_type AS run, date_trunc('hour', ts) AS hour, count(*) AS backlog FROM events GROUP BY 1, 2"


def hourly_counts(spark, d):
    return events(spark, d).groupBy(F.col("event_type").alias("run"), F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("backlog"))


@query("horizon_targets", f"""SELECT run, hour, coalesce(lead(backlog) OVER w, 0) AS target_next_step, coalesce(max(backlog) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS target_horizon_max,
    CAST(coalesce(max(backlog) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) >= 6 AS INTEGER) AS target_binary_burst FROM ({HOURLY}) WINDOW w AS (PARTITION BY run ORDER BY hour)""")
def horizon_targets(spark, d):
    out = od.horizon_targets(hourly_counts(spark, d), ["run"], ["hour"], 3, 3.0)
    return out.select("run", fx.plain("hour").alias("hour"), "target_next_step", "target_horizon_max", "target_binary_burst")


@query("moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM events")
def moving_average(spark, d):
    out = od.moving_average(events(spark, d), ["event_type"], ["ts", "event_id"], "value", 10)
    return out.select("event_id", r6("moving_avg").alias("moving_avg"))


@query("ewma", """WITH o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), e AS (
    SELECT event_id, user_id, rn, value AS v FROM o WHERE rn = 1 UNION ALL SELECT o.event_id, o.user_id, o.rn, 0.3::DOUBLE * o.value + 0.7::DOUBLE * e.v FROM e JOIN o ON o.user_id = e.user_id AND o.rn = e.rn + 1)
    SELECT event_id, round(v + 1e-9, 6) AS ewma FROM e""", recursive=True)
def ewma(spark, d):
    out = od.ewma(events(spark, d).select("event_id", "user_id", "value", "ts"), ["user_id"], ["ts", "event_id"], "value")
    return out.select("event_id", r6(F.col("ewma") + 1e-9).alias("ewma"))


@query("running_normalize", """SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE round(greatest(-10.0::DOUBLE, least(10.0::DOUBLE, (value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-8))), 5) END AS normalized
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_normalize(spark, d):
    out = od.running_normalize(events(spark, d).select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value")
    return out.select("event_id", F.round("normalized", 5).alias("normalized"))


@query("anomaly_flags", """WITH f AS (SELECT key, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM metric_points WINDOW w AS (PARTITION BY name ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING))
    SELECT key, value > 150 AS over, round(coalesce(abs((value - m) / (s + 1e-9)), 0), 4) AS z, coalesce(abs((value - m) / (s + 1e-9)) > 3, false) AS z_anomaly FROM f""", ("metric_points",))
def anomaly_flags(spark, d):
    out = od.anomaly_flags(fx.metric_points(spark, d), ["name"], 86400, 150.0, 3.0)
    return out.select("key", "over", F.round("z", 4).alias("z"), "z_anomaly")


@query("anomaly_latest", """WITH p AS (SELECT name, key, ts, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY name) AS n FROM metric_points
    WHERE ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20'), q AS (SELECT name, count(*) AS n, arg_max(value, (ts, key)) AS last, max(CASE WHEN rn = floor(0.25::DOUBLE * n) THEN value END) AS q1,
    max(CASE WHEN rn = floor(0.75::DOUBLE * n) THEN value END) AS q3 FROM p GROUP BY 1) SELECT name, n, last, q1, q3, round(q3 + 1.5::DOUBLE * (q3 - q1), 6) AS upper, last > q3 + 1.5::DOUBLE * (q3 - q1) AS iqr_anomaly FROM q""", ("metric_points",))
def anomaly_latest(spark, d):
    out = od.anomaly_latest(fx.metric_points(spark, d), ["name"], at(T0), 86400, 1.5)
    return out.withColumn("upper", r6("upper"))


@query("rate_limit_flags", """SELECT event_id, count(*) OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS in_window,
    count(*) OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) > 3 AS limited FROM events""")
def rate_limit_flags(spark, d):
    ev = events(spark, d).withColumn("target", F.col("user_id") % 10)
    return od.rate_limit_flags(ev, ["target"], 3, 7200).select("event_id", "in_window", "limited")


@query("baseline_drift", """WITH o AS (SELECT event_id, event_type, value AS obs, value * (event_id % 3) AS reward, row_number() OVER w AS rn, avg(value) OVER f AS mo, avg(value * (event_id % 3)) OVER f AS mr FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id), f AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
    b AS (SELECT event_type, avg(obs) AS bo, stddev_pop(obs) AS so, avg(reward) AS br, stddev_pop(reward) AS sr FROM o WHERE rn <= 50 GROUP BY 1),
    s AS (SELECT event_id, greatest(abs(mo - bo) / (so + 1e-8), abs(mr - br) / (sr + 1e-8)) AS s FROM o JOIN b USING (event_type) WHERE rn >= 50) SELECT event_id, round(s, 6) AS drift_score, s > 0.3 AS drift FROM s""")
def baseline_drift(spark, d):
    ev = events(spark, d).withColumn("reward", F.col("value") * (F.col("event_id") % 3))
    out = od.baseline_drift(ev, ["event_type"], ["ts", "event_id"], "value", "reward", 50)
    return out.select("event_id", r6("drift_score").alias("drift_score"), "drift")


@query("improvement_reward", """WITH h AS (SELECT hour, backlog, p95, n % 7 AS delta, lag(p95) OVER (ORDER BY hour) AS pp, lag(backlog) OVER (ORDER BY hour) AS bb FROM hourly_stats)
    SELECT hour, round(CASE WHEN pp IS NULL THEN 0 ELSE greatest(0.0::DOUBLE, pp - p95) + 0.2::DOUBLE * greatest(0.0::DOUBLE, bb - backlog) - CASE WHEN p95 > 5 THEN (p95 - 5) * 2 ELSE 0 END END - 0.1::DOUBLE * abs(delta), 6) AS reward FROM h""", ("hourly_stats",))
def improvement_reward(spark, d):
    h = fx.hourly_stats(spark, d).select("hour", "backlog", "p95", (F.col("n") % 7).alias("delta"))
    out = od.improvement_reward(h, [], ["hour"], 5.0)
    return out.select(fx.plain("hour").alias("hour"), r6("reward").alias("reward"))


@query("oscillation", """SELECT event_id, max(CASE WHEN action = 'scale_up' THEN 1 ELSE 0 END) OVER w = 1 AND max(CASE WHEN action = 'scale_down' THEN 1 ELSE 0 END) OVER w = 1 AS oscillating
    FROM scaling_actions WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", ("scaling_actions",))
def oscillation(spark, d):
    out = od.oscillation(fx.scaling_actions(spark, d), [], ["ts", "event_id"])
    return out.select("event_id", "oscillating")


@query("stall_gaps", """SELECT event_id, round((epoch_us(nx) - epoch_us(ts)) / 1e6, 6) AS gap_s FROM (SELECT event_id, ts, lead(ts) OVER (ORDER BY ts, event_id) AS nx FROM scaling_actions) WHERE epoch_us(nx) - epoch_us(ts) > 600000000""", ("scaling_actions",))
def stall_gaps(spark, d):
    out = od.stall_gaps(fx.scaling_actions(spark, d), [], ["ts", "event_id"], 600)
    return out.select("event_id", r6("gap_s").alias("gap_s"))


@query("cumulative_processed", f"SELECT run, hour, CAST(sum(backlog) OVER (PARTITION BY run ORDER BY hour) AS BIGINT) AS backlog_cumulative FROM ({HOURLY})")
def cumulative_processed(spark, d):
    out = od.cumulative(hourly_counts(spark, d), ["run"], ["hour"], "backlog")
    return out.select("run", fx.plain("hour").alias("hour"), "backlog_cumulative")


@query("dlq_growth", """SELECT * FROM (SELECT concat_ws(':', 'queue', tenant, task_type) AS queue_key, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'reserved') AS in_flight,
    count(*) FILTER (status = 'dead') AS dlq, count(*) AS total FROM tasks GROUP BY 1) WHERE dlq > 1 AND pending < 190""", ("tasks",))
def dlq_growth(spark, d):
    return od.dlq_growth(ag.queue_depth(fx.tasks(spark, d), queue_key("tenant", "task_type")), 1, 190)


def requests(spark, d):
    return events(spark, d).select("event_id", "user_id", "event_type", "ts", "value", (F.col("event_type") != "error").alias("ok"))


@query("hysteresis_actions", """WITH RECURSIVE o AS (SELECT event_id, event_type, score, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM scaling_actions), s(event_type, rn, event_id, kept) AS (
    SELECT event_type, 0::BIGINT, -1::BIGINT, 0.0::DOUBLE FROM o WHERE rn = 1 UNION ALL SELECT o.event_type, o.rn, o.event_id, greatest(-2.0::DOUBLE, least(2.0::DOUBLE, CASE WHEN abs(o.score - s.kept) < 0.15::DOUBLE THEN s.kept ELSE o.score END))
    FROM s JOIN o ON o.event_type = s.event_type AND o.rn = s.rn + 1) SELECT event_id, kept AS kept_score, CASE WHEN kept > 0.15::DOUBLE THEN 'scale_up' WHEN kept < -0.15::DOUBLE THEN 'scale_down' ELSE 'steady' END AS kept_action FROM s WHERE rn > 0""", ("scaling_actions",))
def hysteresis_actions(spark, d):
    a = fx.scaling_actions(spark, d)
    out = od.hysteresis(a, ["event_type"], ["ts", "event_id"], "score")
    return out.select("event_id", "kept_score", "kept_action")


@query("cooldown_filter", """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), s(user_id, rn, event_id, last, act) AS (
    SELECT user_id, rn, event_id, us, true FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.rn, o.event_id, CASE WHEN o.us - s.last >= 86400000000 THEN o.us ELSE s.last END, o.us - s.last >= 86400000000
    FROM s JOIN o ON o.user_id = s.user_id AND o.rn = s.rn + 1) SELECT event_id, user_id FROM s WHERE act""")
def cooldown_filter(spark, d):
    out = od.cooldown_filter(requests(spark, d), ["user_id"], ["ts", "event_id"], 86400)
    return out.select("event_id", "user_id")


@query("token_bucket", """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), s(user_id, rn, event_id, us, tokens, ok) AS (
    SELECT user_id, rn, event_id, us, 3.0::DOUBLE - 1, true FROM o WHERE rn = 1 UNION ALL SELECT user_id, rn, event_id, us, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1 FROM (
    SELECT o.user_id, o.rn, o.event_id, o.us, least(3.0::DOUBLE, s.tokens + (o.us - s.us) / 1e6::DOUBLE * 0.00005::DOUBLE) AS t FROM s JOIN o ON o.user_id = s.user_id AND o.rn = s.rn + 1)) SELECT event_id, ok AS allowed FROM s""")
def token_bucket(spark, d):
    out = od.token_bucket(requests(spark, d), ["user_id"], ["ts", "event_id"], 0.00005, 3.0)
    return out.select("event_id", "allowed")


def _breaker(spark, d, variant, **cfg):
    reqs = requests(spark, d).withColumn("target", F.col("user_id") % 20)
    out = od.circuit_breaker(reqs, ["target"], ["ts", "event_id"], variant, **cfg)
    return out.select("event_id", "target", "state", "allowed")


@query("circuit_breaker_window", """WITH RECURSIVE o AS (SELECT event_id, user_id % 20 AS target, event_type <> 'error' AS ok, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS rn FROM events),
    s(target, rn, event_id, mode, changed, fails, allowed) AS (SELECT target, 0::BIGINT, -1::BIGINT, 'closed', 0::BIGINT, []::BIGINT[], true FROM o WHERE rn = 1 UNION ALL
    SELECT target, rn, event_id, CASE WHEN md = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN md = 'closed' AND len(f2) >= 3 THEN 'open' ELSE md END,
      CASE WHEN md = 'half_open' AND pm = 'open' THEN us WHEN NOT ok AND md = 'closed' AND len(f2) >= 3 THEN us ELSE changed END,
      CASE WHEN md = 'open' THEN fails WHEN ok THEN CASE WHEN md = 'half_open' THEN [] ELSE fails END ELSE f2 END, md <> 'open' FROM (
      SELECT o.*, s.mode AS pm, s.changed, s.fails, CASE WHEN s.mode = 'open' AND o.us - s.changed > 43200000000 THEN 'half_open' ELSE s.mode END AS md,
      list_append(list_filter(s.fails, lambda x: x >= o.us - 43200000000), o.us) AS f2 FROM s JOIN o ON o.target = s.target AND o.rn = s.rn + 1))
    SELECT event_id, target, mode AS state, allowed FROM s WHERE rn > 0""")
def circuit_breaker_window(spark, d):
    return _breaker(spark, d, "window", threshold=3, window_s=43200)


@query("circuit_breaker_share", """WITH RECURSIVE o AS (SELECT event_id, user_id % 20 AS target, event_type <> 'error' AS ok, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS rn,
      count(*) FILTER (event_type = 'error') OVER w AS fails, count(*) FILTER (event_type <> 'error') OVER w AS oks FROM events WINDOW w AS (PARTITION BY user_id % 20 ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)),
    s(target, rn, event_id, mode, changed, allowed) AS (SELECT target, 0::BIGINT, -1::BIGINT, 'closed', 0::BIGINT, true FROM o WHERE rn = 1 UNION ALL
    SELECT target, rn, event_id, CASE WHEN ok AND md <> 'closed' AND oks >= 10 THEN 'closed' WHEN trip THEN 'open' ELSE md END, CASE WHEN trip THEN us ELSE changed END, md <> 'open' FROM (
      SELECT *, NOT ok AND md = 'closed' AND fails >= 4 AND fails / greatest(1, fails + oks) > 0.3::DOUBLE AS trip FROM (
      SELECT o.*, s.changed, CASE WHEN s.mode = 'open' AND o.us - s.changed > 86400000000 THEN 'half_open' ELSE s.mode END AS md FROM s JOIN o ON o.target = s.target AND o.rn = s.rn + 1)))
    SELECT event_id, target, mode AS state, allowed FROM s WHERE rn > 0""")
def circuit_breaker_share(spark, d):
    return _breaker(spark, d, "share", threshold=4, window_s=86400, share=0.3, recover=10)


@query("circuit_breaker", """WITH RECURSIVE o AS (SELECT event_id, user_id % 20 AS target, event_type <> 'error' AS ok, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS rn FROM events),
    s(target, rn, event_id, us, fails, until, good, allowed) AS (SELECT target, 0::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, true FROM o WHERE rn = 1 UNION ALL
    SELECT target, rn, event_id, us, CASE WHEN blocked THEN fails WHEN ok THEN 0 ELSE fails + 1 END,
      CASE WHEN blocked THEN until WHEN ok AND until > 0 AND us > until AND good + 1 >= 3 THEN 0 WHEN NOT ok AND fails + 1 >= 2 THEN us + 43200000000 ELSE until END,
      CASE WHEN blocked THEN good WHEN ok THEN CASE WHEN until > 0 AND us > until AND good + 1 >= 3 THEN 0 ELSE good + 1 END WHEN fails + 1 >= 2 THEN 0 ELSE good END, NOT blocked FROM (
      SELECT o.*, s.fails, s.until, s.good, s.until > 0 AND o.us < s.until AS blocked FROM s JOIN o ON o.target = s.target AND o.rn = s.rn + 1))
    SELECT event_id, target, CASE WHEN until > 0 AND us < until THEN 'open' WHEN until > 0 THEN 'half_open' ELSE 'closed' END AS state, allowed FROM s WHERE rn > 0""")
def circuit_breaker(spark, d):
    return _breaker(spark, d, "streak", trip=2, open_s=43200, successes=3)


@query("gae", """WITH RECURSIVE c AS (SELECT run_id, t, reward, reward * 0.5::DOUBLE + t AS value, t = 5 AS done, coalesce(lead(reward * 0.5::DOUBLE + t) OVER (PARTITION BY run_id ORDER BY t), 0) AS nv,
    row_number() OVER (PARTITION BY run_id ORDER BY t DESC) AS rn FROM run_log), d AS (SELECT *, reward + 0.99::DOUBLE * nv * (CASE WHEN done THEN 0 ELSE 1 END) - value AS delta FROM c), g(run_id, t, rn, value, a) AS (
    SELECT run_id, t, rn, value, delta FROM d WHERE rn = 1 UNION ALL SELECT d.run_id, d.t, d.rn, d.value, d.delta + 0.99::DOUBLE * 0.95::DOUBLE * (CASE WHEN d.done THEN 0 ELSE 1 END) * g.a FROM g JOIN d ON d.run_id = g.run_id AND d.rn = g.rn + 1)
    SELECT run_id, t, round((a - avg(a) OVER ()) / (stddev_samp(a) OVER () + 1e-8), 6) AS advantage, round(a + value, 6) AS returns FROM g""", ("run_log",))
def gae(spark, d):
    steps = fx.run_log(spark, d).select("run_id", "t", "reward", (F.col("reward") * 0.5 + F.col("t")).alias("value"), (F.col("t") == 5).alias("done"))
    out = od.gae(steps, "run_id", ["t"], normalize=True)
    return out.select("run_id", "t", r6("advantage").alias("advantage"), r6("returns").alias("returns"))
