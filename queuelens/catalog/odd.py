"""The same operators over rows with what the plain tables lack: null keys, null values, equal times, ids beyond 2^53."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuelens import fixtures as fx
from queuelens.catalog.aggregates import T0, at
from queuelens.catalog.registry import query
from queuelens.operators import aggregates as ag
from queuelens.operators import ordered as od
from queuelens.operators.aggregates import r6

BIG = 9_007_199_254_740_993
ODD = ("odd_points",)


def odd_points(spark, folder):
    """Events with null names and values, whole hours as times and ids that no double can tell apart."""
    return fx.table(spark, folder, "events").select(
        (F.col("event_id") + BIG).alias("key"), F.when(F.col("user_id") % 5 != 0, F.col("event_type")).alias("name"),
        F.when(F.col("event_id") % 7 != 0, F.floor("value").cast("double")).alias("value"), F.date_trunc("hour", "ts").alias("ts"))


SORTED = "SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY name) AS n FROM p WHERE value IS NOT NULL"


@query("odd_window_snapshot", f"""WITH p AS (SELECT name, value FROM odd_points WHERE epoch(ts) <= epoch(TIMESTAMP '2024-01-20') AND epoch(ts) > epoch(TIMESTAMP '2024-01-20') - 86400),
    g AS (SELECT name, count(*) AS count, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM p GROUP BY 1), s AS ({SORTED}),
    q AS (SELECT name, max(CASE WHEN rn = floor(0.5::DOUBLE * (n - 1)) THEN value END) AS p50, max(CASE WHEN rn = floor(0.95::DOUBLE * (n - 1)) THEN value END) AS p95 FROM s GROUP BY 1)
    SELECT g.*, 86400 AS window_s, p50, p95 FROM g LEFT JOIN q ON g.name IS NOT DISTINCT FROM q.name""", ODD)
def odd_window_snapshot(spark, d):
    return ag.window_snapshot(odd_points(spark, d), [86400], at(T0))


@query("odd_recent_stats", f"""WITH p AS (SELECT name, value FROM odd_points WHERE ts <= TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-13'), g AS (SELECT name, count(*) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM p GROUP BY 1),
    s AS ({SORTED}), q AS (SELECT name, max(CASE WHEN rn = greatest(floor(n * 0.9::DOUBLE) - 1, 0) THEN value END) AS p90 FROM s GROUP BY 1) SELECT g.*, p90 FROM g LEFT JOIN q ON g.name IS NOT DISTINCT FROM q.name""", ODD)
def odd_recent_stats(spark, d):
    return ag.recent_stats(odd_points(spark, d), 7 * 86400, at(T0))


@query("odd_timing_summary", """WITH g AS (SELECT name, avg(value) AS m, stddev_pop(value) AS s, count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM odd_points GROUP BY 1)
    SELECT name, round(m, 6) AS mean, round(s, 6) AS std, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, round(1 / m, 6) AS rate, n FROM g""", ODD)
def odd_timing_summary(spark, d):
    return ag.timing_summary(odd_points(spark, d), "name", "value")


@query("odd_latency_bucket", """SELECT key, CAST(greatest(ceil((row_number() OVER (ORDER BY value, key) - 1) * 5 / (count(*) OVER () - 1)) - 1, 0) AS INTEGER) AS label FROM odd_points WHERE value IS NOT NULL""", ODD)
def odd_latency_bucket(spark, d):
    points = odd_points(spark, d).filter("value is not null")
    return od.latency_bucket(points, "value", "key", 5, "label").select("key", "label")


@query("odd_moving_average", "SELECT key, round(avg(value) OVER (PARTITION BY name ORDER BY ts, key ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM odd_points", ODD)
def odd_moving_average(spark, d):
    return od.moving_average(odd_points(spark, d), ["name"], ["ts", "key"], "value", 5).select("key", r6("moving_avg").alias("moving_avg"))


@query("odd_versions", "SELECT key, row_number() OVER (PARTITION BY name ORDER BY ts, key) AS version FROM odd_points", ODD)
def odd_versions(spark, d):
    """Slices of fifty rows, so that small tables are cut as well."""
    return od.version_history(odd_points(spark, d), ["name"], ["ts", "key"], slice_rows=50).select("key", "version")


@query("odd_rate_limit", "SELECT key, count(*) OVER w AS in_window, count(*) OVER w > 3 AS limited FROM odd_points WINDOW w AS (PARTITION BY name ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW)", ODD)
def odd_rate_limit(spark, d):
    return od.rate_limit_flags(odd_points(spark, d), ["name"], 3, 7200, slice_rows=50).select("key", "in_window", "limited")


@query("odd_anomaly", """WITH f AS (SELECT key, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM odd_points WINDOW w AS (PARTITION BY name ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING))
    SELECT key, value > 150 AS over, round(coalesce(abs((value - m) / (s + 1e-9)), 0), 4) AS z FROM f""", ODD)
def odd_anomaly(spark, d):
    out = od.anomaly_flags(odd_points(spark, d), ["name"], 86400, 150.0, 3.0, slice_rows=50)
    return out.select("key", "over", F.round("z", 4).alias("z"))


@query("odd_cooldown", """WITH RECURSIVE o AS (SELECT key, coalesce(name, '?') AS name, epoch_us(ts) AS us, row_number() OVER (PARTITION BY name ORDER BY ts, key) AS rn FROM odd_points), s(name, rn, key, last, act) AS (
    SELECT name, rn, key, us, true FROM o WHERE rn = 1 UNION ALL SELECT o.name, o.rn, o.key, CASE WHEN o.us - s.last >= 21600000000 THEN o.us ELSE s.last END, o.us - s.last >= 21600000000
    FROM s JOIN o ON o.name = s.name AND o.rn = s.rn + 1) SELECT key FROM s WHERE act""", ODD)
def odd_cooldown(spark, d):
    return od.cooldown_filter(odd_points(spark, d), ["name"], ["ts", "key"], 21600, slice_rows=50).select("key")


@query("odd_breaker", """WITH RECURSIVE o AS (SELECT key, coalesce(name, '?') AS name, key % 3 <> 0 AS ok, epoch_us(ts) AS us, row_number() OVER (PARTITION BY name ORDER BY ts, key) AS rn FROM odd_points),
    s(name, rn, key, us, fails, until, good, allowed) AS (SELECT name, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, true FROM o WHERE rn = 1 UNION ALL
    SELECT name, rn, key, us, CASE WHEN blocked THEN fails WHEN ok THEN 0 ELSE fails + 1 END,
      CASE WHEN blocked THEN until WHEN ok AND until > 0 AND us > until AND good + 1 >= 2 THEN 0 WHEN NOT ok AND fails + 1 >= 2 THEN us + 10800000000 ELSE until END,
      CASE WHEN blocked THEN good WHEN ok THEN CASE WHEN until > 0 AND us > until AND good + 1 >= 2 THEN 0 WHEN until > 0 THEN good + 1 ELSE 0 END WHEN fails + 1 >= 2 THEN 0 ELSE good END, NOT blocked FROM (
      SELECT o.*, s.fails, s.until, s.good, s.until > 0 AND o.us < s.until AS blocked FROM s JOIN o ON o.name = s.name AND o.rn = s.rn + 1))
    SELECT key, CASE WHEN until > 0 AND us < until THEN 'open' WHEN until > 0 THEN 'half_open' ELSE 'closed' END AS state, allowed FROM s WHERE rn > 0""", ODD)
def odd_breaker(spark, d):
    """Opening times that end exactly at a request's time: whole hours."""
    rows = odd_points(spark, d).withColumn("ok", F.col("key") % 3 != 0)
    return od.circuit_breaker(rows, ["name"], ["ts", "key"], "streak", slice_rows=50, trip=2, open_s=10800, successes=2).select("key", "state", "allowed")
