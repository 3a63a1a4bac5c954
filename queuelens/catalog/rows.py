"""Queries of section 2.3."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuelens import fixtures as fx
from queuelens.catalog.aggregates import T0, at
from queuelens.catalog.registry import query
from queuelens.functions import columns as fc
from queuelens.operators import rows as rw
from queuelens.operators.aggregates import r6

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@query("basic_clean", """SELECT task_id, CASE WHEN task_id % 50 = 7 THEN NULL ELSE "timestamp" END AS ts,
    success, CASE WHEN task_id % 40 = 3 THEN 0 ELSE duration_ms END AS duration_ms,
    CASE WHEN task_id % 9 = 0 THEN 0 ELSE queue_length END AS queue_length, 0 AS priority, consumer_count FROM telemetry""",
       ("telemetry",))
def basic_clean(spark, d):
    t = fx.telemetry(spark, d)
    raw = t.select(
        "task_id", F.when(F.col("task_id") % 50 == 7, "not a time").otherwise(F.date_format("timestamp", ISO)).alias("timestamp"),
        (F.col("success") == 1).cast("string").alias("success"),
        F.when(F.col("task_id") % 40 == 3, "n/a").otherwise(F.col("duration_ms").cast("string")).alias("duration_ms"),
        F.when(F.col("task_id") % 9 != 0, F.col("queue_length")).alias("queue_length"), "consumer_count")
    out = rw.basic_clean(raw)
    return out.select("task_id", fx.plain("ts").alias("ts"), "success", "duration_ms", "queue_length", "priority",
                      "consumer_count")


@query("label_filter", """SELECT key, name, value, ts FROM metric_points WHERE k = 7 AND user_id % 10 = 3
    UNION ALL SELECT key, name, value, ts FROM metric_points WHERE k = 8 AND user_id = 5""", ("metric_points",))
def label_filter(spark, d):
    pts = fx.metric_points(spark, d)
    by_k = rw.label_filter(pts, {"k": "7"}).filter(F.col("labels")["user"].cast("long") % 10 == 3)
    both = rw.label_filter(pts, {"k": "8", "user": "5"})
    return by_k.unionByName(both).select("key", "name", "value", fx.plain("ts").alias("ts"))


@query("time_range", """SELECT key, name, value, ts FROM metric_points
    WHERE ts BETWEEN TIMESTAMP '2024-01-19 06:00:00' AND TIMESTAMP '2024-01-20'""", ("metric_points",))
def time_range(spark, d):
    out = rw.time_range(fx.metric_points(spark, d), at("2024-01-19 06:00:00"), at(T0))
    return out.select("key", "name", "value", fx.plain("ts").alias("ts"))


@query("text_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'mentre') OR contains(lower(source), 'mentre')")
def text_search(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.filter(fc.text_match(["text", "source"], "Mentre")).select("doc_id")


@query("normalize_task_records", """SELECT event_id, CAST(event_id AS VARCHAR) AS id,
    CASE WHEN event_id % 10 = 0 THEN 'generic' ELSE event_type END AS type, '{"k":' || CAST(json_extract_string(props, '$.k') AS INTEGER) || '}' AS payload,
    CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 7 AS INTEGER) ELSE 0 END AS retries, ts AS created_at FROM events""")
def normalize_task_records(spark, d):
    ev = fx.table(spark, d, "events")
    kind = F.when(F.col("event_id") % 10 != 0, F.col("event_type"))
    body = F.struct(fx.k_of().alias("k"))
    when = F.date_format("ts", ISO)
    new = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), kind.alias("type"), body.alias("payload"),
                             (F.col("event_id") % 7).alias("retries"), when.alias("created_at")))
    old = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), kind.alias("task_type"), body.alias("data"),
                             when.alias("created_at")))
    raw = ev.select("event_id", F.when(F.col("event_id") % 2 == 0, new).otherwise(old).alias("raw"))
    return rw.normalize_tasks(raw, "raw").withColumn("created_at", fx.plain("created_at"))


DUR_SQL = """regexp_extract_all(lower(dur), '(\\d+\\.?\\d*)\\s*([a-z]+)', 1) AS v,
    regexp_extract_all(lower(dur), '(\\d+\\.?\\d*)\\s*([a-z]+)', 2) AS u"""


@query("parse_times", f"""WITH e AS (SELECT event_id, ts, (user_id % 3) || 'd ' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 24) || 'H '
    || (event_id % 60) || '.5min ' || (event_id % 5) || 'blip' AS dur FROM events), p AS (SELECT event_id, ts, {DUR_SQL} FROM e)
    SELECT event_id, CASE WHEN event_id % 3 = 1 THEN date_trunc('second', ts) WHEN event_id % 11 = 0 AND event_id % 3 <> 0 THEN NULL
    ELSE ts END AS ts, list_sum(list_transform(range(1, len(v) + 1), lambda i: CAST(v[i] AS DOUBLE) * CASE u[i] WHEN 'd' THEN 86400
    WHEN 'h' THEN 3600 WHEN 'min' THEN 60 ELSE 1 END)) AS seconds FROM p""")
def parse_times(spark, d):
    ev = fx.table(spark, d, "events")
    e = F.col("event_id")
    text = (F.when(e % 3 == 1, F.unix_seconds("ts").cast("string"))
            .when((e % 11 == 0) & (e % 3 != 0), F.lit("2024-01-01T00:00:00+00:00Z"))
            .otherwise(F.concat(F.date_format("ts", ISO), F.lit("Z"))))
    dur = F.concat_ws("", (F.col("user_id") % 3).cast("string"), F.lit("d "), (fx.k_of() % 24).cast("string"), F.lit("H "),
                      (e % 60).cast("string"), F.lit(".5min "), (e % 5).cast("string"), F.lit("blip"))
    return ev.select("event_id", fx.plain(fc.parse_instant(text)).alias("ts"), fc.parse_duration(dur).alias("seconds"))


@query("validate_route", """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), r AS (
    SELECT event_id, concat_ws(',', CASE WHEN value <= 2 THEN 'value' END, CASE WHEN k >= 90 THEN 'k' END,
    CASE WHEN event_type = 'error' THEN 'type' END) AS error FROM e)
    SELECT event_id AS original_id, error, CASE WHEN error = '' THEN 'valid' ELSE 'dlq' END AS route FROM r""")
def validate_route(spark, d):
    ev = fx.table(spark, d, "events")
    rules = {"value": F.col("value") > 2, "k": fx.k_of() < 90, "type": F.col("event_type") != "error"}
    valid, dead = rw.validate_route(ev, rules, "events", F.to_json(F.struct("event_id", "value")), "event_id", at(T0))
    good = valid.select(F.col("event_id").alias("original_id"), F.lit("").alias("error"), F.lit("valid").alias("route"))
    return good.unionByName(dead.select("original_id", "error", F.lit("dlq").alias("route")))


SETTINGS = [("limit", "int"), ("price", "float"), ("enabled", "bool"), ("tag", "str"), ("ratio", "int")]


@query("config_type_check", """WITH c AS (SELECT o_orderkey AS id, unnest(['limit', 'price', 'enabled', 'tag', 'ratio', 'free']) AS key,
    unnest([CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 4 = 0 THEN 'abc' ELSE CAST(o_custkey AS VARCHAR) || '.25' END,
    CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN '0' ELSE 'maybe' END, o_orderpriority,
    CAST(o_custkey AS VARCHAR) || '.5', o_orderstatus]) AS value FROM orders)
    SELECT id, key, CASE key WHEN 'limit' THEN true WHEN 'price' THEN TRY_CAST(value AS DOUBLE) IS NOT NULL
    WHEN 'enabled' THEN lower(value) IN ('true', 'false', '1', '0') WHEN 'ratio' THEN regexp_full_match(value, '[+-]?[0-9]+')
    ELSE true END AS valid FROM c""")
def config_type_check(spark, d):
    o = fx.table(spark, d, "orders")
    cust = F.col("o_custkey").cast("string")
    pairs = {"limit": cust, "price": F.when(F.col("o_orderkey") % 4 == 0, "abc").otherwise(F.concat(cust, F.lit(".25"))),
             "enabled": F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", "0").otherwise("maybe"),
             "tag": F.col("o_orderpriority"), "ratio": F.concat(cust, F.lit(".5")), "free": F.col("o_orderstatus")}
    cfg = o.select(F.col("o_orderkey").alias("id"), F.explode(F.create_map(
        *[x for k, v in pairs.items() for x in (F.lit(k), v)])).alias("key", "value"))
    schema = spark.createDataFrame(SETTINGS, "key string, expected_type string")
    return rw.check_types(cfg, schema).select("id", "key", "valid")


@query("mask_column", """SELECT c_custkey, substr(c_name, 1, 4) || repeat('*', length(c_name) - 4) AS name,
    repeat('*', length(CAST(c_custkey AS VARCHAR))) AS short FROM customer""")
def mask_column(spark, d):
    return fx.table(spark, d, "customer").select(
        "c_custkey", fc.mask("c_name").alias("name"), fc.mask(F.col("c_custkey").cast("string")).alias("short"))


@query("nan_inf_check", """SELECT count(*) FILTER (isnan(v)) AS nan_count, count(*) FILTER (isinf(v)) AS inf_count,
    CASE WHEN count(*) FILTER (isnan(v) OR isinf(v)) > 0 THEN 'FAILED' ELSE 'PASSED' END AS stability, g, false AS above_max,
    CASE WHEN g = 0 THEN avg(v) < 60 ELSE false END AS below_min FROM (SELECT event_id % 2 AS g, CASE WHEN event_id % 2 = 0 THEN value
    WHEN event_id % 101 = 0 THEN 'nan'::DOUBLE WHEN event_id % 103 = 0 THEN 'inf'::DOUBLE ELSE value END AS v FROM events) GROUP BY g""")
def nan_inf_check(spark, d):
    ev = fx.table(spark, d, "events")
    e = F.col("event_id")
    odd = ev.filter(e % 2 == 1).select(F.when(e % 101 == 0, float("nan")).when(e % 103 == 0, float("inf"))
                                       .otherwise(F.col("value")).alias("v"))
    fine = ev.filter(e % 2 == 0).select(F.col("value").alias("v"))
    tag = lambda df, g: rw.nan_check(df, "v", 60.0, 1e9).withColumn("g", F.lit(g).cast("long"))
    return tag(fine, 0).unionByName(tag(odd, 1))


@query("encode_categoricals", """WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY 1),
    u AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY 1)
    SELECT e.event_id, CAST(f.code AS INTEGER) AS event_type, CAST(u.code AS INTEGER) AS user_id FROM events e
    JOIN f ON e.event_type = f.event_type JOIN u ON e.user_id = u.user_id""")
def encode_categoricals(spark, d):
    ev = fx.table(spark, d, "events").select("event_id", "event_type", "user_id")
    return rw.encode_categoricals(ev, ["event_type", "user_id"], "event_id")[0]


@query("feature_matrix", """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS FLOAT) AS l_quantity, CAST(CASE WHEN l_tax > 0.02 THEN l_tax ELSE 0 END AS FLOAT) AS l_tax,
    CAST(l_discount AS FLOAT) AS l_discount, CAST(l_returnflag = 'R' AS BIGINT) AS label FROM lineitem""")
def feature_matrix(spark, d):
    li = fx.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("l_tax"),
        "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("flag"), "l_linestatus")
    return rw.feature_matrix(li, None, "flag", ["l_orderkey", "l_linenumber"])


@query("queue_key", "SELECT task_id, concat_ws(':', 'queue', tenant, task_type) AS queue_key FROM tasks", ("tasks",))
def queue_key(spark, d):
    return fx.tasks(spark, d).select("task_id", fc.queue_key("tenant", "task_type").alias("queue_key"))


OVERRIDES = [("type_1", 40), ("type_3", -300), ("global:type_2", 7), ("3:type_2", 900), ("3:type_1", 1)]


@query("priority_override", """SELECT task_id, CAST(greatest(1, least(1000, priority + coalesce(a.delta, b.delta, 0))) AS INTEGER) AS priority
    FROM tasks t LEFT JOIN (VALUES ('type_1', 40), ('type_3', -300)) a(s, delta) ON t.task_type = a.s
    LEFT JOIN (VALUES ('global:type_2', 7), ('3:type_2', 900), ('3:type_1', 1)) b(s, delta)
    ON coalesce(t.tenant, 'global') || ':' || t.task_type = b.s""", ("tasks",))
def priority_override(spark, d):
    over = spark.createDataFrame(OVERRIDES, "scope string, delta int")
    return rw.priority_override(fx.tasks(spark, d), over).select("task_id", "priority")


@query("retry_decision", """SELECT task_id, attempts + 1 AS attempts_after, CASE WHEN attempts + 1 < 5 THEN 'retry' ELSE 'dead' END AS decision,
    CASE WHEN attempts + 1 < 5 THEN CAST(floor(30 * pow(2.0, attempts)) AS INTEGER) END AS delay_s,
    CASE WHEN task_id % 11 = 0 THEN 'dlq_drop' WHEN attempts + 1 > 5 OR task_id % 13 = 0 THEN 'dlq' ELSE 'retry' END AS worker_decision,
    CASE WHEN NOT (task_id % 11 = 0 OR attempts + 1 > 5 OR task_id % 13 = 0) THEN CAST(pow(2, least(6, attempts + 1)) AS INTEGER) END AS worker_delay_s
    FROM tasks""", ("tasks",))
def retry_decision(spark, d):
    t = F.col("task_id")
    return fx.tasks(spark, d).select(
        "task_id", *[c.alias(n) for n, c in rw.retry_decision(F.col("attempts")).items()],
        *[c.alias(n) for n, c in rw.worker_retry_decision(F.col("attempts"), t % 11 == 0, t % 13 != 0).items()])


@query("backoff_schedule", """SELECT task_id, CAST(attempt AS INTEGER) AS attempt, least(1.5::DOUBLE * pow(2.0::DOUBLE, attempt), 20.0::DOUBLE) AS delay_s
    FROM (SELECT task_id, unnest(range(0, attempts + 1)) AS attempt FROM tasks)""", ("tasks",))
def backoff_schedule(spark, d):
    return rw.backoff_schedule(fx.tasks(spark, d).select("task_id", "attempts"), F.col("attempts"), 1.5, 2.0, 20.0).select(
        "task_id", "attempt", "delay_s")


@query("scale_hint", """SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 'scale_up' WHEN value / 100 <= 0.3 THEN 'scale_down' ELSE 'steady' END AS hint FROM events""")
def scale_hint(spark, d):
    return fx.table(spark, d, "events").select("event_id", fc.scale_hint(F.col("value") / 100).alias("hint"))


RULE_SQL = """greatest(-2.0::DOUBLE, least(2.0::DOUBLE, (CASE WHEN backlog >= 1000 THEN 1.2::DOUBLE WHEN backlog <= 50 THEN -1.0::DOUBLE ELSE 0 END)
    + (CASE WHEN latency >= 1.5 THEN 1.0::DOUBLE WHEN latency <= 0.7 THEN -0.8::DOUBLE ELSE 0 END)
    + (CASE WHEN cpu >= 0.8 THEN 0.6::DOUBLE WHEN cpu <= 0.35 THEN -0.4::DOUBLE ELSE 0 END)))"""


@query("rule_score", f"SELECT hour, round({RULE_SQL}, 6) AS score FROM hourly_stats", ("hourly_stats",))
def rule_score(spark, d):
    return fx.hourly_stats(spark, d).select(fx.plain("hour").alias("hour"), r6(fc.rule_score()).alias("score"))


@query("fuse_scores", f"""WITH s AS (SELECT hour, {RULE_SQL} AS rule, CASE WHEN n % 5 <> 0 THEN tanh((p95 - 4) / greatest(1.0::DOUBLE, n + 1.0::DOUBLE) * 3.0::DOUBLE) END AS ml,
    CASE WHEN n % 3 <> 0 THEN cpu - 0.5::DOUBLE END AS rl FROM hourly_stats), w AS (SELECT *, 0.5::DOUBLE + CASE WHEN ml IS NULL THEN 0 ELSE 0.3::DOUBLE END
    + CASE WHEN rl IS NULL THEN 0 ELSE 0.2::DOUBLE END AS w FROM s), f AS (SELECT hour, greatest(-2.0::DOUBLE, least(2.0::DOUBLE,
    (rule * 0.5::DOUBLE + coalesce(ml * 0.3::DOUBLE, 0) + coalesce(rl * 0.2::DOUBLE, 0)) / w)) AS f FROM w)
    SELECT hour, round(f, 6) AS score, CASE WHEN f > 0.15 THEN 'scale_up' WHEN f < -0.15 THEN 'scale_down' ELSE 'steady' END AS action FROM f""",
       ("hourly_stats",))
def fuse_scores(spark, d):
    h = fx.hourly_stats(spark, d)
    scored = h.select(fx.plain("hour").alias("hour"), fc.fuse_scores(
        fc.rule_score(), F.when(F.col("n") % 5 != 0, fc.ml_hint(F.col("p95") - 4, "n")),
        F.when(F.col("n") % 3 != 0, F.col("cpu") - 0.5)).alias("f"))
    return scored.select("hour", r6("f").alias("score"), fc.score_action("f").alias("action"))


POLICY_COLS = ("policy_id string, metric string, mode string, min_replicas int, max_replicas int, up double, down double, "
               "hysteresis double, current int, ml int, rl int, cooldown_s int, in_cooldown boolean, priority int")
POLICIES = [
    ("p1", "click", "rule", 1, 20, 60.0, 10.0, 0.1, 4, None, None, 43200, False, 1),
    ("p2", "view", "rule", 2, 30, 500.0, 200.0, 0.05, 9, None, None, 86400, False, 2),
    ("p3", "error", "ml", 1, 10, 50.0, 5.0, 0.1, 3, 7, 5, 43200, False, 3),
    ("p4", "purchase", "hybrid", 1, 50, 40.0, 5.0, 0.2, 6, 3, 12, 86400, False, 4),
    ("p5", "signup", "hybrid", 1, 50, None, 500.0, 0.1, 0, 8, 2, 86400, False, 5),
    ("p6", "click", "hybrid", 1, 50, 900.0, None, 0.1, 6, 3, None, 21600, True, 6),
    ("p7", "absent", "ml", 3, 9, 900.0, 1.0, 0.1, None, 0, None, 21600, False, 7),
]


def _sql_value(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


POLICY_SQL = ", ".join("(" + ", ".join(_sql_value(v) for v in row) + ")" for row in POLICIES)


@query("desired_replicas", f"""WITH pol AS (SELECT policy_id, metric, mode, min_replicas, max_replicas, CAST(up AS DOUBLE) AS up, CAST(down AS DOUBLE) AS down,
    CAST(hysteresis AS DOUBLE) AS h, coalesce(nullif("current", 0), min_replicas) AS cur, ml, rl, cooldown_s, in_cooldown FROM (VALUES {POLICY_SQL})
    v(policy_id, metric, mode, min_replicas, max_replicas, up, down, hysteresis, "current", ml, rl, cooldown_s, in_cooldown, priority)),
    r AS (SELECT policy_id, value, row_number() OVER (PARTITION BY policy_id ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY policy_id) AS n
    FROM events JOIN pol ON event_type = metric WHERE ts <= TIMESTAMP '2024-01-20' AND epoch(TIMESTAMP '2024-01-20') - epoch(ts) <= cooldown_s * 2),
    s AS (SELECT pol.*, coalesce((SELECT max(value) FROM r WHERE r.policy_id = pol.policy_id AND rn = greatest(floor(n * 0.9::DOUBLE) - 1, 0)), 0) AS p90 FROM pol),
    u AS (SELECT *, CAST(CASE WHEN up IS NOT NULL AND p90 >= up THEN least(max_replicas, cur + greatest(1, ceil((max_replicas - min_replicas) * least(p90 / (up + 1e-9) - 1.0, 2.0) * (1 + h))))
    WHEN down IS NOT NULL AND p90 <= down THEN greatest(min_replicas, cur - greatest(1, ceil(cur * (1 - p90 / (down + 1e-9)) * (1 + h)))) END AS BIGINT) AS rule FROM s),
    o AS (SELECT *, list_sort(list_filter([rule, ml, rl], lambda x: x IS NOT NULL)) AS opts FROM u),
    q AS (SELECT *, CASE mode WHEN 'rule' THEN coalesce(nullif(rule, 0), cur) WHEN 'ml' THEN coalesce(nullif(ml, 0), nullif(rl, 0), cur)
    ELSE CASE WHEN len(opts) = 0 THEN cur WHEN rule > cur THEN list_max(opts) WHEN rule < cur THEN list_min(opts) ELSE opts[len(opts) // 2 + 1] END END AS pick FROM o),
    z AS (SELECT *, CAST(greatest(min_replicas, least(max_replicas, pick)) AS BIGINT) AS desired FROM q)
    SELECT policy_id, p90, rule, desired, desired - cur AS delta, CASE WHEN in_cooldown THEN 'skipped' WHEN desired = cur THEN 'no_change' ELSE 'scale' END AS outcome FROM z""")
def desired_replicas(spark, d):
    policies = spark.createDataFrame(POLICIES, POLICY_COLS)
    stats = rw.policy_stats(fx.metric_points(spark, d), policies, at(T0))
    return rw.desired_replicas(stats).select("policy_id", "p90", "rule", "desired", "delta", "outcome")


@query("build_observation", """SELECT hour, backlog AS queue_length, CAST(n AS DOUBLE) AS consumer_count, latency AS avg_latency_ms, p95 AS p95_latency_ms,
    CASE WHEN n % 4 = 0 THEN 1.0::DOUBLE ELSE success_rate END AS success_rate, 0.0::DOUBLE AS arrival_rate, cpu,
    CASE WHEN n % 3 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS mem FROM hourly_stats""", ("hourly_stats",))
def build_observation(spark, d):
    text = lambda c: F.col(c).cast("string")
    h = fx.hourly_stats(spark, d)
    even = F.col("n") % 2 == 0
    pairs = [F.when(even, "queue_length").otherwise("queue"), text("backlog"),
             F.when(even, "worker_count").otherwise("consumer_count"), text("n"),
             F.when(even, "avg_latency_ms").otherwise("avg_lat_ms"), text("latency"),
             F.when(even, "p95_lat_ms").otherwise("p95_latency_ms"), text("p95"),
             F.when(F.col("n") % 4 == 0, "other").otherwise("success_rate"), text("success_rate"),
             F.lit("arrival"), F.lit("n/a"), F.lit("cpu"), text("cpu"),
             F.when(F.col("n") % 3 == 0, "x").otherwise("memory_utilization"), F.lit("0.5")]
    return h.select(fx.plain("hour").alias("hour"), F.create_map(*pairs).alias("m")).select("hour", *fc.build_observation("m"))


@query("normalize_observation", f"""SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(greatest(-5.0::DOUBLE, least(5.0::DOUBLE,
    CAST(embedding[i] AS DOUBLE) * 5000 / (([{', '.join(f'{s}::DOUBLE' for s in fc.OBSERVATION_SCALES)}])[i] + 1e-8))), 6) AS v FROM embeddings, range(1, 13) r(i)""")
def normalize_observation(spark, d):
    emb = fx.table(spark, d, "embeddings")
    obs = F.transform(F.slice("embedding", 1, 12), lambda v: v.cast("double") * 5000)
    return emb.select("vec_id", F.posexplode(fc.normalize_obs(obs)).alias("dim", "v")).withColumn("v", r6("v"))


@query("heuristic_action", """WITH o AS (SELECT hour, backlog / 10 AS q, n % 30 AS c, latency * 500 AS lat FROM hourly_stats), a AS (
    SELECT *, CASE WHEN lat > 500 AND q > c * 2 THEN least(10, greatest(1, CAST(ceil(q / greatest(1, c)) - 1 AS INTEGER)))
    WHEN q < greatest(5, floor(c / 2)) THEN -1 ELSE 0 END AS w FROM o)
    SELECT hour, CAST(CASE WHEN c + w < 1 THEN 1 - c WHEN c + w > 200 THEN 200 - c ELSE w END AS INTEGER) AS delta,
    round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, lat / 500.0::DOUBLE - 1.0)), 6) AS throttle, CAST(lat > 500 AS INTEGER) AS priority FROM a""", ("hourly_stats",))
def heuristic_action(spark, d):
    o = fx.hourly_stats(spark, d).select("hour", (F.col("backlog") / 10).alias("queue_len"), (F.col("n") % 30).alias("consumers"),
                                         (F.col("latency") * 500).alias("avg_lat"))
    a = fc.heuristic_action()
    return o.select(fx.plain("hour").alias("hour"), a["delta"].alias("delta"), r6(a["throttle"]).alias("throttle"),
                    a["priority"].alias("priority"))


@query("slo_score", """WITH s AS (SELECT hour, p95 * 300 AS p, success_rate AS s, backlog * 10 AS q, n % 20 AS w, n % 20 - n % 3 AS healthy,
    cpu / 100 AS cost, n % 5 AS delta FROM hourly_stats), t AS (SELECT *, w * (healthy / greatest(1.0::DOUBLE, w)) * s AS done, q / (200000.0::DOUBLE + 1e-8) AS share FROM s)
    SELECT hour, round(greatest(-20.0::DOUBLE, least(20.0::DOUBLE, -tanh((p - 2000) / (2000.0::DOUBLE + 1e-8)) * 2 - tanh((0.995::DOUBLE - s) / (0.995::DOUBLE + 1e-8) * 3) * 3
    + CASE WHEN done > 0 THEN -tanh(cost / done / 0.001::DOUBLE - 1) ELSE -1 END - tanh((share - 0.3::DOUBLE) * 3)
    - tanh(abs(q / greatest(1.0::DOUBLE, w * 10.0::DOUBLE) - 0.65::DOUBLE) * 2) * 0.5::DOUBLE - tanh(abs(delta) / 10.0::DOUBLE) * 0.3::DOUBLE
    + CASE WHEN p <= 2000 AND s >= 0.995::DOUBLE AND share < 0.5 THEN 2 ELSE 0 END)), 6) AS score, p <= 2000 AS p95_met, s >= 0.995::DOUBLE AS success_met FROM t""",
       ("hourly_stats",))
def slo_score(spark, d):
    n = F.col("n")
    h = fx.hourly_stats(spark, d).select("hour", (F.col("p95") * 300).alias("p95"), "success_rate", (F.col("backlog") * 10).alias("queue"),
                                         (n % 20).alias("workers"), (n % 20 - n % 3).alias("healthy"), (F.col("cpu") / 100).alias("cost"), (n % 5).alias("delta"))
    s = fc.slo_score()
    return h.select(fx.plain("hour").alias("hour"), r6(s["score"]).alias("score"), s["p95_met"].alias("p95_met"), s["success_met"].alias("success_met"))


@query("coupon_valid", """SELECT p_partkey AS coupon_id, count(l_partkey) AS used, CASE WHEN TIMESTAMP '1996-01-01' + to_days(p_size * 40) < TIMESTAMP '1998-01-01' THEN 'expired'
    WHEN p_size % 45 > 0 AND count(l_partkey) >= p_size % 45 THEN 'used_up' ELSE 'valid' END AS state FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size""")
def coupon_valid(spark, d):
    coupons = fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("coupon_id"), (F.col("p_size") % 45).alias("max_redemptions"),
        (at("1996-01-01 00:00:00") + F.make_interval(days=F.col("p_size") * 40)).alias("expires_at"))
    used = fx.table(spark, d, "lineitem").select(F.col("l_partkey").alias("coupon_id"))
    return rw.coupon_valid(coupons, used, at("1998-01-01 00:00:00")).select("coupon_id", "used", "state")


STAB_SQL = """WITH r AS (SELECT p_partkey AS version_id, CASE p_size % 4 WHEN 0 THEN 0.99::DOUBLE WHEN 1 THEN 0.995::DOUBLE WHEN 2 THEN 0.97::DOUBLE END AS gamma,
    CASE WHEN p_size % 3 = 0 THEN 0.97::DOUBLE WHEN p_size % 3 = 1 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS lam,
    CASE WHEN p_partkey % 5 = 0 THEN 0.001::DOUBLE WHEN p_partkey % 5 = 1 THEN 0.0005::DOUBLE ELSE 0.0003::DOUBLE END AS lr,
    CASE WHEN p_partkey % 7 = 0 THEN 4096 WHEN p_partkey % 7 = 1 THEN 1024 ELSE 2048 END AS steps, p_partkey % 3 <> 0 AS clip, p_size / 100.0::DOUBLE AS vc,
    p_partkey % 11 <> 0 AS na, p_partkey % 13 <> 0 AS nob, p_partkey % 17 <> 0 AS nr, CASE WHEN p_partkey % 4 <> 0 THEN p_size / 20.0::DOUBLE END AS mgn,
    p_size * 5.0::DOUBLE - 120 AS vm, p_size / 400.0::DOUBLE AS kl FROM part), f AS (SELECT *,
    [coalesce(gamma >= 0.995::DOUBLE, false), coalesce(gamma < 0.995::DOUBLE AND abs(gamma - 0.99::DOUBLE) > 0.01::DOUBLE, false), lam >= 0.97::DOUBLE,
     lam < 0.97::DOUBLE AND abs(lam - 0.95::DOUBLE) > 0.01::DOUBLE, lr >= 0.001::DOUBLE, lr < 0.001::DOUBLE AND lr NOT IN (0.0003::DOUBLE, 0.0001::DOUBLE),
     steps >= 4096, steps < 4096 AND steps <> 2048, NOT clip AND vc <= 0.25::DOUBLE, NOT clip, NOT na, NOT nob, NOT nr, mgn IS NULL OR mgn > 1.0] AS h FROM r)
    SELECT version_id, greatest(0.0::DOUBLE, 100.0::DOUBLE - list_sum(list_transform(range(1, 15), lambda i: CASE WHEN h[i] THEN [40, 10, 40, 10, 40, 10, 30, 5, 50, 50, 10, 40, 10, 10][i] ELSE 0 END))) AS stability_score,
    NOT (h[1] OR h[3] OR h[5] OR h[7] OR h[9] OR h[10] OR h[12]) AS stable,
    array_to_string(list_filter(list_transform(range(1, 15), lambda i: CASE WHEN h[i] THEN ['gamma_high','gamma_off','lam_high','lam_off','lr_high','lr_off','steps_high','steps_off','value_coef_low','value_loss_not_clipped','advantages_raw','observations_raw','rewards_raw','grad_norm'][i] END), lambda x: x IS NOT NULL), ',') AS issues,
    concat_ws(',', CASE WHEN abs(vm) > 100 THEN 'value_explosion' END, CASE WHEN kl > 0.1::DOUBLE THEN 'kl_divergence' END) AS metric_issues,
    NOT (abs(vm) > 100 OR kl > 0.1::DOUBLE) AS metrics_stable FROM f"""


@query("config_stability", STAB_SQL)
def config_stability(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    runs = fx.table(spark, d, "part").select(
        k.alias("version_id"), F.when(s % 4 == 0, 0.99).when(s % 4 == 1, 0.995).when(s % 4 == 2, 0.97).alias("gamma"),
        F.when(s % 3 == 0, 0.97).when(s % 3 == 1, 0.95).otherwise(0.9).alias("lam"),
        F.when(k % 5 == 0, 0.001).when(k % 5 == 1, 0.0005).otherwise(0.0003).alias("lr"),
        F.when(k % 7 == 0, 4096).when(k % 7 == 1, 1024).otherwise(2048).alias("steps_per_epoch"),
        (k % 3 != 0).alias("use_clipped_value_loss"), (s / 100.0).alias("value_coef"), (k % 11 != 0).alias("normalize_advantages"),
        (k % 13 != 0).alias("normalize_observations"), (k % 17 != 0).alias("normalize_rewards"),
        F.when(k % 4 != 0, s / 20.0).alias("max_grad_norm"), (s * 5.0 - 120).alias("value_mean"), (s / 400.0).alias("kl_div"))
    out = rw.metric_stability(rw.config_stability(runs))
    return out.select("version_id", "stability_score", "stable", "issues", "metric_issues", "metrics_stable")


@query("promotion_decision", """WITH b AS (SELECT model_type, arg_max(rmse, version_id) AS base FROM model_runs WHERE active AND version_id % 3 <> 0 GROUP BY 1),
    j AS (SELECT version_id, CASE WHEN version_id % 23 <> 0 THEN rmse END AS rmse, n_samples, base FROM model_runs LEFT JOIN b USING (model_type)), r AS (
    SELECT *, CASE WHEN rmse IS NULL THEN 'metric_missing' WHEN n_samples < 50 THEN 'insufficient_samples' WHEN rmse <= 1.2 THEN 'absolute_threshold'
    WHEN base > 0 THEN CASE WHEN (base - rmse) / base >= 0.1 THEN 'relative_improvement' ELSE 'insufficient_improvement' END ELSE 'no_promotion_condition_met' END AS reason FROM j)
    SELECT version_id, reason, reason IN ('absolute_threshold', 'relative_improvement') AS promote, coalesce(rmse <= 3.0, false) AS canary_ok,
    coalesce(base > 0 AND (rmse - base) / base > 0.2, false) AS regressed FROM r""", ("model_runs",))
def promotion_decision(spark, d):
    runs = fx.model_runs(spark, d)
    base = runs.filter(F.col("active") & (F.col("version_id") % 3 != 0)).groupBy("model_type").agg(
        F.max_by("rmse", "version_id").alias("rmse"))
    cand = runs.withColumn("rmse", F.when(F.col("version_id") % 23 != 0, F.col("rmse")))
    out = rw.promotion_decision(cand, base, "model_type", 50, 1.2, 0.1, 3.0)
    return out.select("version_id", "reason", "promote", "canary_ok", "regressed")


@query("hint_dedup", """WITH q AS (SELECT 'q' || (user_id % 40) AS queue, count(*) AS n, avg(value) AS rate FROM events GROUP BY 1), h AS (
    SELECT queue, CAST(n % 9 AS INTEGER) AS suggested, 'rl_agent' AS source, 0 AS r FROM q UNION ALL
    SELECT queue, CAST(greatest(1, ceil(round(rate, 6) / 10.0)) AS INTEGER), 'predictor', 1 FROM q WHERE round(rate, 6) > 5)
    SELECT queue, suggested, source FROM h QUALIFY row_number() OVER (PARTITION BY queue ORDER BY suggested DESC, r) = 1""")
def hint_dedup(spark, d):
    q = fx.table(spark, d, "events").groupBy(F.concat(F.lit("q"), (F.col("user_id") % 40).cast("string")).alias("queue")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("rate"))
    return rw.hint_dedup(q.select("queue", (F.col("n") % 9).alias("suggested")), q.select("queue", "rate"))


@query("replay_to_xy", """SELECT run_id || '-' || t AS id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN i <= 64 THEN embedding[i] ELSE CAST(t AS FLOAT) END AS x, CAST(reward AS FLOAT) AS y
    FROM run_log JOIN embeddings ON vec_id = run_id, range(1, 66) r(i)""", ("run_log",))
def replay_to_xy(spark, d):
    log = fx.run_log(spark, d).withColumnRenamed("run_id", "vec_id")
    emb = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("state"))
    out = rw.replay_to_xy(log.join(emb, "vec_id").select(
        F.concat_ws("-", "vec_id", "t").alias("id"), "state", F.col("t").alias("action"), "reward"))
    return out.select("id", "y", F.posexplode("x").alias("pos", "x"))


@query("route_by_condition", """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'F' THEN 'large'
    WHEN CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 100.0 / (o_custkey % 7) END > 30 THEN 'ratio' ELSE 'default' END AS route FROM orders""")
def route_by_condition(spark, d):
    rules = [("large", "o_totalprice > 300000 AND o_orderstatus = 'F'"), ("ratio", "try_divide(100.0, o_custkey % 7) > 30"), ("never", "")]
    return rw.route_by_condition(fx.table(spark, d, "orders"), rules).select("o_orderkey", "route")


@query("billing_columns", """SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents,
    CASE WHEN round(c_acctbal * 100) < 0 THEN '-' ELSE '' END || CAST(floor(abs(round(c_acctbal * 100)) / 100) AS BIGINT) || '.' ||
    lpad(CAST(CAST(abs(round(c_acctbal * 100)) AS BIGINT) % 100 AS VARCHAR), 2, '0') || ' USD' AS amount,
    TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) + INTERVAL 30 DAY AS period_end,
    CASE WHEN c_custkey % 3 = 0 THEN 'trialing' ELSE 'active' END AS status FROM customer""")
def billing_columns(spark, d):
    cu = fx.table(spark, d, "customer")
    start = at("2024-01-01 00:00:00") + F.make_interval(days=(F.col("c_custkey") % 365).cast("int"))
    cents = fc.to_cents("c_acctbal")
    return cu.select("c_custkey", cents.alias("cents"), fc.money_text(cents).alias("amount"),
                     fx.plain(start + F.expr("INTERVAL 30 DAYS")).alias("period_end"),
                     F.when(F.col("c_custkey") % 3 == 0, "trialing").otherwise("active").alias("status"))


@query("activate_version", """WITH c AS (SELECT max(version_id) AS version_id FROM model_runs GROUP BY model_type), m AS (
    SELECT m.*, c.version_id IS NOT NULL AS pick FROM model_runs m LEFT JOIN c ON m.version_id = c.version_id), n AS (
    SELECT *, pick AND score >= 70 AND version_id % 19 <> 0 AS nw FROM m)
    SELECT version_id, CASE WHEN bool_or(nw) OVER (PARTITION BY model_type) THEN nw ELSE active END AS active, pick AND NOT nw AS blocked FROM n""",
       ("model_runs",))
def activate_version(spark, d):
    models = fx.model_runs(spark, d).withColumn("stable", F.col("version_id") % 19 != 0)
    chosen = models.groupBy("model_type").agg(F.max("version_id").alias("version_id"))
    return rw.activate_version(models, chosen).select("version_id", "active", "blocked")


@query("overdue_runs", """SELECT experiment_id, CASE WHEN late THEN 'completed' ELSE status END AS status, CASE WHEN late THEN TIMESTAMP '2024-01-20' END AS stopped_at FROM (
    SELECT *, status = 'running' AND epoch(TIMESTAMP '2024-01-20') - epoch(started_at) > duration_seconds + 30 AS late FROM experiments)""", ("experiments",))
def overdue_runs(spark, d):
    out = rw.overdue_runs(fx.experiments(spark, d), at(T0))
    return out.select("experiment_id", "status", fx.plain("stopped_at").alias("stopped_at"))


@query("restart_decision", """WITH d AS (SELECT *, CASE worker_type WHEN 'w0' THEN 'always' WHEN 'w1' THEN 'on-failure' ELSE 'never' END AS p FROM workers), v AS (
    SELECT *, CASE WHEN status = 'running' THEN 'none' WHEN NOT (CASE WHEN exit_code <> 0 THEN p IN ('always', 'on-failure') ELSE p = 'always' END) THEN 'not_allowed'
    WHEN restarts >= 5 THEN 'exhausted' ELSE 'restart' END AS decision FROM d)
    SELECT worker_id, decision, CASE WHEN decision = 'restart' THEN least(6.0::DOUBLE, 1.0::DOUBLE * pow(2, greatest(0, restarts - 1))) END AS backoff_s FROM v""", ("workers",))
def restart_decision(spark, d):
    t = F.col("worker_type")
    policy = F.when(t == "w0", "always").when(t == "w1", "on-failure").otherwise("never")
    return rw.restart_decision(fx.workers(spark, d), policy, 5, 1.0, 6.0).select("worker_id", "decision", "backoff_s")
