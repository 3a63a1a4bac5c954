"""Queries of section 2.4."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuelens import fixtures as fx
from queuelens.catalog.aggregates import T0, at
from queuelens.catalog.registry import query
from queuelens.operators import lookups as lk
from queuelens.operators.aggregates import r6


@query("estimate_invoices", """WITH u AS (SELECT customer_id, CAST(sum(quantity) AS BIGINT) AS usage_total FROM usage
    WHERE ts BETWEEN TIMESTAMP '1997-12-03' AND TIMESTAMP '1998-06-01' GROUP BY 1), j AS (
    SELECT c.c_custkey AS customer_id, coalesce(usage_total, 0) AS usage_total, coalesce(price, 0) + CASE WHEN quota > 0 THEN greatest(0, coalesce(usage_total, 0) - quota) * overage ELSE 0 END AS s
    FROM customer c LEFT JOIN (SELECT * FROM subscriptions WHERE customer_id % 8 <> 0) b ON c.c_custkey = b.customer_id LEFT JOIN plans p ON p.plan_id = b.plan_id
    LEFT JOIN u ON u.customer_id = c.c_custkey)
    SELECT customer_id, usage_total, round(s, 6) AS subtotal, round(s * 0.0825::DOUBLE, 6) AS tax, round(s + s * 0.0825::DOUBLE, 6) AS total FROM j""",
       ("usage", "subscriptions", "plans"))
def estimate_invoices(spark, d):
    subs = fx.subscriptions(spark, d)
    out = lk.estimate_invoices(subs.select("customer_id"), subs.filter(F.col("customer_id") % 8 != 0), fx.plans(spark),
                               fx.usage(spark, d), at("1998-06-01 00:00:00"), 180, 8.25)
    return out.select("customer_id", "usage_total", *[r6(c).alias(c) for c in ("subtotal", "tax", "total")])


NODES = [(f"type_{i}", f"n{i}_{j}", 86400.0 * (365 * (j + 1) + 400 * i) if j < 3 else None) for i in range(5) for j in range(4)]


@query("sla_violations", f"""SELECT task_id AS run_id, node_id, sla_seconds, epoch(TIMESTAMP '2000-01-01') - epoch(created_at) AS elapsed FROM tasks
    JOIN (VALUES {', '.join(f"('{w}', '{n}', {'NULL' if s is None else s}::DOUBLE)" for w, n, s in NODES)}) v(wf, node_id, sla_seconds) ON task_type = wf
    WHERE status = 'pending' AND epoch(TIMESTAMP '2000-01-01') - epoch(created_at) > sla_seconds""", ("tasks",))
def sla_violations(spark, d):
    nodes = spark.createDataFrame(NODES, "workflow_id string, node_id string, sla_seconds double")
    runs = fx.tasks(spark, d).select(
        F.col("task_id").alias("run_id"), F.col("task_type").alias("workflow_id"), F.col("created_at").alias("started_at"),
        F.when(F.col("status") == "pending", "running").otherwise("done").alias("status"))
    return lk.sla_violations(runs, nodes, at("2000-01-01 00:00:00"))


@query("resolve_overrides", """SELECT n_name AS org, r_name AS key, CASE WHEN n_nationkey % 3 <> 0 THEN 'own ' || n_name WHEN r_regionkey <> 4 THEN 'default ' || r_name END AS value,
    CASE WHEN n_nationkey % 3 <> 0 THEN 'org' WHEN r_regionkey <> 4 THEN 'global' ELSE 'none' END AS source FROM nation JOIN region ON n_regionkey = r_regionkey""")
def resolve_overrides(spark, d):
    nation, region = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    orgs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("org"), F.col("r_name").alias("key"), "n_nationkey")
    config = region.filter(F.col("r_regionkey") != 4).select(
        F.col("r_name").alias("key"), F.concat(F.lit("default "), F.col("r_name")).alias("value"))
    own = orgs.filter(F.col("n_nationkey") % 3 != 0).select("org", "key", F.concat(F.lit("own "), F.col("org")).alias("value"))
    return lk.resolve_overrides(orgs, config, own)


RULES = [("a", ["latency"], ["*"], 40, 5000), ("b", ["latency", "cpu"], ["ns0", "ns1"], 30, 3000), ("c", ["cpu"], ["ns1"], 60, 9000)]


@query("policy_check", """WITH p AS (SELECT * FROM (VALUES ('latency', '*', 40, 5000), ('latency', 'ns0', 30, 3000), ('latency', 'ns1', 30, 3000), ('cpu', 'ns0', 30, 3000),
    ('cpu', 'ns1', 30, 3000), ('cpu', 'ns1', 60, 9000)) v(fault, ns, mc, md)), a AS (SELECT target, count(*) AS n FROM experiments WHERE status IN ('running', 'pending') GROUP BY 1),
    m AS (SELECT e.experiment_id, e.duration_seconds, coalesce(a.n, 0) AS n, min(mc) AS mc, min(md) AS md FROM experiments e LEFT JOIN p ON p.fault = e.fault AND p.ns IN ('*', e.namespace)
    LEFT JOIN a ON a.target = e.target GROUP BY 1, 2, 3), r AS (SELECT experiment_id, CASE WHEN mc IS NULL THEN 'no_policy_allows_fault' WHEN n >= mc THEN 'concurrent_limit_reached'
    WHEN duration_seconds > md THEN 'duration_exceeds_policy_max (' || md || 's)' END AS reason FROM m) SELECT experiment_id, reason IS NULL AS allowed, reason FROM r""", ("experiments",))
def policy_check(spark, d):
    policies = spark.createDataFrame(RULES, "policy_id string, faults array<string>, namespaces array<string>, max_concurrent int, max_duration int")
    return lk.policy_check(fx.experiments(spark, d), policies)


@query("invalid_edges", """SELECT workflow, src || '->' || dst AS item, 'unknown_source' AS issue FROM graph_edges e WHERE NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.workflow = e.workflow AND n.node_id = e.src)
    UNION ALL SELECT workflow, src || '->' || dst, 'unknown_target' FROM graph_edges e WHERE NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.workflow = e.workflow AND n.node_id = e.dst)
    UNION ALL SELECT workflow, node_id, 'missing_template' FROM graph_nodes WHERE kind = 'task' AND template IS NULL""", ("graph_nodes", "graph_edges"))
def invalid_edges(spark, d):
    return lk.invalid_edges(fx.graph_nodes(spark, d), fx.graph_edges(spark, d))


DAG_SQL = """WITH c AS (SELECT n_regionkey AS workflow, 'n' || n_nationkey AS src, 'c' || c_custkey AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey),
    e AS (SELECT DISTINCT * FROM (SELECT * FROM graph_edges UNION ALL SELECT * FROM c)), n AS (SELECT workflow, node_id FROM graph_nodes UNION ALL SELECT workflow, dst FROM c),
    inner_e AS (SELECT * FROM e WHERE dst IN (SELECT src FROM e)), reach(workflow, a, b) AS (SELECT workflow, src, dst FROM inner_e UNION SELECT r.workflow, r.a, x.dst FROM reach r JOIN inner_e x ON x.workflow = r.workflow AND x.src = r.b)
    SELECT n.workflow, n.workflow NOT IN (SELECT workflow FROM reach WHERE a = b) AS acyclic, count(*) AS nodes, (SELECT count(*) FROM e WHERE e.workflow = n.workflow) AS edges,
    count(*) FILTER (node_id NOT IN (SELECT dst FROM e)) AS start_nodes, count(*) FILTER (node_id NOT IN (SELECT src FROM e)) AS end_nodes FROM n GROUP BY 1"""


@query("dag_check", DAG_SQL, ("graph_nodes", "graph_edges"), recursive=True)
def dag_check(spark, d):
    leaf = (fx.table(spark, d, "customer").join(fx.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_regionkey").alias("workflow"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"),
                    F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dst")))
    nodes = fx.graph_nodes(spark, d).select("workflow", "node_id").unionByName(leaf.select("workflow", F.col("dst").alias("node_id")))
    return lk.dag_check(nodes, fx.graph_edges(spark, d).unionByName(leaf))


@query("tree_diff", """SELECT CASE WHEN c_custkey % 10 = 5 THEN 'new/' || c_name ELSE c_name END AS path, CASE c_custkey % 10 WHEN 0 THEN 'left_only' WHEN 5 THEN 'right_only'
    WHEN 2 THEN 'size_mismatch' WHEN 1 THEN 'hash_mismatch' ELSE 'same' END AS status FROM customer""")
def tree_diff(spark, d):
    cu = fx.table(spark, d, "customer")
    k = F.col("c_custkey") % 10
    side = lambda name, size, text: cu.select(k.alias("k"), name.alias("path"), size.alias("size"), F.sha2(text, 256).alias("sha256"))
    left = side(F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).filter(F.col("k") != 5)
    right = side(F.when(k == 5, F.concat(F.lit("new/"), F.col("c_name"))).otherwise(F.col("c_name")),
                 F.col("c_nationkey") + F.when(k == 2, 1).otherwise(0),
                 F.when(k == 1, F.concat(F.col("c_mktsegment"), F.lit("!"))).otherwise(F.col("c_mktsegment"))).filter(F.col("k") != 0)
    return lk.tree_diff(left, right)


@query("missing_refs", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def missing_refs(spark, d):
    known = fx.table(spark, d, "customer").filter(F.col("c_custkey") % 10 != 0).select(F.col("c_custkey").alias("o_custkey"))
    return lk.missing_refs(fx.table(spark, d, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey")


@query("apply_payment_events", """WITH e AS (SELECT event_id, event_id // 3 AS invoice_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS type,
    CAST(floor(value * 100) AS BIGINT) AS amount_cents, ts FROM events WHERE event_type IN ('error', 'click', 'purchase')), n AS (SELECT invoice_id, arg_max(type, (ts, event_id)) AS type,
    arg_max(amount_cents, (ts, event_id)) FILTER (type = 'succeeded') AS paid_amount_cents FROM e GROUP BY 1)
    SELECT i.invoice_id, coalesce(type = 'succeeded', paid) AS paid, CASE type WHEN 'succeeded' THEN 'paid' WHEN 'failed' THEN 'past_due' ELSE 'open' END AS status, paid_amount_cents
    FROM invoices i LEFT JOIN n USING (invoice_id)""", ("invoices",))
def apply_payment_events(spark, d):
    ev = fx.table(spark, d, "events").filter(F.col("event_type").isin("error", "click", "purchase")).select(
        "event_id", F.floor(F.col("event_id") / 3).alias("invoice_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("type"),
        F.floor(F.col("value") * 100).cast("long").alias("amount_cents"), "ts")
    return lk.apply_payment_events(fx.invoices(spark, d), ev)


@query("apply_subscription_events", """WITH n AS (SELECT user_id, arg_max(CASE event_type WHEN 'view' THEN 'past_due' ELSE 'canceled' END, (ts, event_id)) AS s FROM events WHERE event_type IN ('view', 'signup') GROUP BY 1)
    SELECT customer_id, coalesce(s, 'active') AS status FROM subscriptions LEFT JOIN n ON user_id = customer_id""", ("subscriptions",))
def apply_subscription_events(spark, d):
    ev = fx.table(spark, d, "events").filter(F.col("event_type").isin("view", "signup")).select(
        F.col("user_id").alias("external_id"), F.when(F.col("event_type") == "view", "past_due").otherwise("canceled").alias("status"),
        "ts", "event_id")
    subs = fx.subscriptions(spark, d).select("customer_id", F.col("customer_id").alias("external_id"), F.lit("active").alias("status"))
    return lk.apply_subscription_events(subs, ev).select("customer_id", "status")


@query("expired_inflight", """SELECT i.task_id, CASE WHEN status = 'reserved' THEN 'requeue' ELSE 'drop' END AS action, CASE WHEN status = 'reserved' THEN 'pending' ELSE status END AS status
    FROM inflight i LEFT JOIN tasks t ON t.task_id = i.task_id WHERE deadline <= TIMESTAMP '1998-01-01'""", ("inflight", "tasks"))
def expired_inflight(spark, d):
    return lk.expired_inflight(fx.inflight(spark, d), fx.tasks(spark, d), at("1998-01-01 00:00:00"))


@query("consumer_lag", """WITH e AS (SELECT l_returnflag AS topic, l_suppkey % 4 AS p, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT l_returnflag AS topic, l_linestatus AS g, l_suppkey % 4 AS p, count(*) AS o
    FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_suppkey % 4 <> 3 GROUP BY 1, 2, 3), k AS (SELECT DISTINCT topic, g FROM c)
    SELECT k.topic, k.g AS "group", CAST(sum(n - coalesce(o, 0)) AS BIGINT) AS lag, count(*) AS partitions FROM k JOIN e ON e.topic = k.topic LEFT JOIN c ON c.topic = k.topic AND c.g = k.g AND c.p = e.p GROUP BY 1, 2""")
def consumer_lag(spark, d):
    li = fx.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("topic"), F.col("l_linestatus").alias("group"), (F.col("l_suppkey") % 4).alias("partition"), "l_shipdate")
    ends = li.groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("end_offset"))
    done = li.filter((F.col("l_shipdate") < at("1998-01-01 00:00:00")) & (F.col("partition") != 3)).groupBy(
        "topic", "group", "partition").agg(F.count(F.lit(1)).alias("offset"))
    return lk.consumer_lag(done, ends)


@query("new_versions", "SELECT version_id, model_type FROM model_runs WHERE version_id % 3 <> 0 AND rmse < 2", ("model_runs",))
def new_versions(spark, d):
    index = fx.model_runs(spark, d)
    seen = index.filter(F.col("version_id") % 3 == 0).select("version_id")
    return lk.new_versions(index, seen, F.col("rmse") < 2).select("version_id", "model_type")
