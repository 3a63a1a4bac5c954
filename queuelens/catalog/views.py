"""DuckDB twins of ``queuelens.fixtures``: SQL text of each derived table."""

from __future__ import annotations

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

VIEWS = {
    "metric_points": f"""SELECT event_id AS key, event_type AS name, {K} AS k, user_id, value, ts,
        'events' AS source FROM events""",
    "odd_points": """SELECT event_id + 9007199254740993 AS key, CASE WHEN user_id % 5 <> 0 THEN event_type END AS name,
        CASE WHEN event_id % 7 <> 0 THEN floor(value) END AS value, date_trunc('hour', ts) AS ts FROM events""",
    "task_history": """SELECT event_id, user_id AS task_id, CASE event_type WHEN 'error' THEN 'fail'
        WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'dequeue' ELSE 'ack' END AS event, ts FROM events""",
    "telemetry": f"""SELECT ts AS "timestamp", user_id AS run_id, event_id AS task_id, event_type AS task_type,
        CAST(floor(value * 10) AS INTEGER) AS duration_ms, CAST(event_type <> 'error' AS INTEGER) AS success,
        CAST(1 + event_id % 8 AS INTEGER) AS consumer_count, {K} AS queue_length,
        CAST(event_id % 3 AS INTEGER) AS priority FROM events""",
    "scaling_actions": """SELECT event_id, user_id, event_type, CASE event_type WHEN 'purchase' THEN 'scale_up'
        WHEN 'error' THEN 'scale_down' ELSE 'steady' END AS action, CAST(1 + event_id % 20 AS INTEGER) AS "to",
        greatest(-2.0::DOUBLE, least(2.0::DOUBLE, (value - 50) / 50)) AS score, ts FROM events""",
    "hourly_stats": """SELECT hour, n, errors, greatest(0.0::DOUBLE, (round(total, 6) - 500) * 2) AS backlog,
        round(mean, 6) / 50 AS latency, least(1.0::DOUBLE, n / 20) AS cpu, top / 10 AS p95,
        1 - errors / n AS success_rate
        FROM (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, sum(value) AS total, avg(value) AS mean,
              max(value) AS top, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)""",
    "tasks": """SELECT o_orderkey AS task_id, 'type_' || (o_orderkey % 5) AS task_type,
        CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 10 AS VARCHAR) END AS tenant,
        CASE o_orderpriority WHEN '1-URGENT' THEN 200 WHEN '2-HIGH' THEN 100 WHEN '5-LOW' THEN 10 ELSE 50 END AS priority,
        CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending'
             WHEN o_orderkey % 3 = 0 THEN 'reserved' WHEN o_orderkey % 3 = 1 THEN 'dead' ELSE 'failed' END AS status,
        CAST(o_orderkey % 7 AS INTEGER) AS attempts, o_orderdate AS created_at FROM orders""",
    "inflight": """SELECT task_id, created_at + INTERVAL 60 SECOND AS deadline FROM tasks
        WHERE status = 'reserved' OR (status = 'pending' AND task_id % 10 = 0)""",
    "dlq": "SELECT * FROM tasks WHERE status = 'dead'",
    "usage": """SELECT o_custkey AS customer_id, l_returnflag AS metric, CAST(floor(l_quantity) AS BIGINT) AS quantity,
        l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "invoices": """SELECT o_orderkey AS invoice_id, o_custkey AS customer_id, o_orderdate AS created_at,
        o_orderstatus = 'F' AS paid, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents FROM orders""",
    "invoice_lines": """SELECT l_orderkey AS invoice_id,
        CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT) AS amount_cents,
        CAST(floor(l_quantity) AS BIGINT) AS quantity FROM lineitem""",
    "subscriptions": """SELECT c_custkey AS customer_id, c_mktsegment AS plan_id, c_acctbal AS balance FROM customer""",
    "plans": """SELECT * FROM (VALUES ('AUTOMOBILE', 29.0::DOUBLE, 100::BIGINT, 0.05::DOUBLE),
        ('BUILDING', 49.0::DOUBLE, 500, 0.04::DOUBLE), ('FURNITURE', 0.0::DOUBLE, 0, 0.10::DOUBLE),
        ('HOUSEHOLD', 99.0::DOUBLE, 1000, 0.02::DOUBLE), ('MACHINERY', 199.0::DOUBLE, 2000, 0.01::DOUBLE))
        AS p(plan_id, price, quota, overage)""",
    "model_runs": """SELECT p_partkey AS version_id, p_brand AS model_type, p_size / 10.0::DOUBLE AS rmse,
        TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(p_partkey % 20000 AS INTEGER)) AS created_at,
        p_size % 2 = 0 AS active, p_size * 5 AS n_samples, CAST(p_partkey % 101 AS DOUBLE) AS score,
        p_name AS name FROM part""",
    "workers": """SELECT s_suppkey AS worker_id, 'w' || (s_nationkey % 3) AS worker_type,
        CASE WHEN s_suppkey % 4 < 2 THEN 'running' WHEN s_suppkey % 4 = 2 THEN 'crashed' ELSE 'stopped' END AS status,
        CAST(s_suppkey % 7 AS INTEGER) AS restarts, CAST(s_suppkey % 3 AS INTEGER) AS exit_code,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(s_suppkey AS INTEGER)) AS started_at FROM supplier""",
    "experiments": """SELECT event_id AS experiment_id,
        CASE event_id % 3 WHEN 0 THEN 'latency' WHEN 1 THEN 'kill' ELSE 'cpu' END AS fault,
        'ns' || (user_id % 3) AS namespace, user_id AS target,
        CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'pending' ELSE 'completed' END AS status,
        ts AS started_at, CAST(floor(value * 60) AS BIGINT) AS duration_seconds FROM events""",
    "run_log": """SELECT conv_id AS run_id, turn AS t, role AS node, length(text) / 100.0::DOUBLE AS reward
        FROM conversations""",
    "graph_nodes": """SELECT 'r' || r_regionkey AS node_id, r_regionkey AS workflow, 'start' AS kind,
            NULL::VARCHAR AS template FROM region
        UNION ALL SELECT 'n' || n_nationkey, n_regionkey, 'task', CASE WHEN n_nationkey % 6 <> 0 THEN n_name END FROM nation
        UNION ALL SELECT 's' || s_suppkey, n_regionkey, 'task', s_name FROM supplier
            JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 11 <> 0""",
    "graph_edges": """SELECT n_regionkey AS workflow, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
        UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 's' || s_suppkey FROM supplier
            JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT n_regionkey, 'n' || n_nationkey, 'r0' FROM nation WHERE n_regionkey = 0""",
}
NEEDS = {"inflight": ["tasks"], "dlq": ["tasks"]}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` preceded by the named derived tables as CTEs.

    ``body`` may itself start with ``WITH``; its CTEs then follow the views.
    """
    ordered: list[str] = []
    for name in names:
        for dep in [*NEEDS.get(name, []), name]:
            if dep not in ordered:
                ordered.append(dep)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    text = body.strip()
    if text[:15].upper() == "WITH RECURSIVE ":
        recursive, text = True, "WITH " + text[15:]
    head = "WITH RECURSIVE " if recursive else "WITH "
    if text[:5].upper() == "WITH ":
        return f"{head}{ctes}, {text[5:]}" if ctes else head + text[5:]
    return f"{head}{ctes} {text}" if ctes else text
