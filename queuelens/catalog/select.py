"""Queries of section 2.7."""

from __future__ import annotations

from pyspark.sql import functions as F

from queuelens import fixtures as fx
from queuelens.catalog.registry import query
from queuelens.functions.columns import queue_key
from queuelens.operators import select as sl
from queuelens.operators.aggregates import r6


@query("priority_order", """SELECT concat_ws(':', 'queue', tenant, task_type) AS queue_key, task_id, row_number() OVER (PARTITION BY tenant, task_type ORDER BY priority DESC, created_at, task_id) AS place
    FROM tasks WHERE status = 'pending' QUALIFY place <= 5""", ("tasks",))
def priority_order(spark, d):
    pending = fx.tasks(spark, d).filter(F.col("status") == "pending")
    return sl.priority_order(pending, queue_key("tenant", "task_type"), 5).select(
        "queue_key", "task_id", F.col("place").cast("long").alias("place"))


@query("top_contributors", """SELECT l_orderkey, l_linenumber, l_partkey, x.feature AS feature, round(x.v, 6) AS contribution FROM (SELECT l_orderkey, l_linenumber, l_partkey,
    unnest(list_sort([{'r': -abs(a), 'feature': 'l_quantity', 'v': a}, {'r': -abs(b), 'feature': 'l_extendedprice', 'v': b}, {'r': -abs(c), 'feature': 'l_discount', 'v': c}, {'r': -abs(t), 'feature': 'l_tax', 'v': t}])[1:2]) AS x
    FROM (SELECT *, (l_quantity - 25) / 14 AS a, (l_extendedprice - 50000) / -30000 AS b, (l_discount - 0.05::DOUBLE) * 30 AS c, l_tax * 20 AS t FROM lineitem))""")
def top_contributors(spark, d):
    c = F.col
    parts = {"l_quantity": (c("l_quantity") - 25) / 14, "l_extendedprice": (c("l_extendedprice") - 50000) / -30000,
             "l_discount": (c("l_discount") - 0.05) * 30, "l_tax": c("l_tax") * 20}
    out = sl.top_contributors(fx.table(spark, d, "lineitem"), parts, 2, ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.withColumn("contribution", r6("contribution"))


@query("train_val_test", """WITH h AS (SELECT event_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42-' || event_id), 1, 13) AS BIGINT), event_id) AS rn, count(*) OVER () AS n FROM events)
    SELECT event_id, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM h""")
def train_val_test(spark, d):
    ev = fx.table(spark, d, "events").select("event_id")
    return sl.split_rows(ev, (0.8, 0.1, 0.1), 42, "event_id").select("event_id", "part")


@query("shared_columns", """SELECT 'l_orderkey' AS "column", count(l_orderkey) FILTER (l_orderkey % 2 = 0) AS filled_a, count(l_orderkey) FILTER (l_orderkey % 2 = 1) AS filled_b FROM lineitem UNION ALL
    SELECT 'l_quantity', count(CASE WHEN l_quantity > 5 THEN 1 END) FILTER (l_orderkey % 2 = 0), count(*) FILTER (l_orderkey % 2 = 1) FROM lineitem""")
def shared_columns(spark, d):
    li = fx.table(spark, d, "lineitem")
    a = li.filter(F.col("l_orderkey") % 2 == 0).select("l_orderkey", F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("l_quantity"), "l_tax")
    b = li.filter(F.col("l_orderkey") % 2 == 1).select("l_orderkey", "l_quantity", "l_discount")
    return sl.shared_profile(a, b)
