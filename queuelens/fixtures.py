"""Domain tables derived from the given parquet tables.

Each function has a DuckDB twin of the same name in ``catalog.views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table with its times as instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    for column, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def plain(col):
    """An instant as the zone-less type that query outputs use."""
    return (F.col(col) if isinstance(col, str) else col).cast("timestamp_ntz")


def k_of(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("int")


def metric_points(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_id").alias("key"), F.col("event_type").alias("name"),
        F.create_map(F.lit("k"), k_of().cast("string"), F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        "value", "ts", F.lit("events").alias("source"))


def task_history(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("task_id"),
        F.when(kind == "error", "fail").when(kind == "signup", "enqueue").when(kind == "view", "dequeue")
        .otherwise("ack").alias("event"), "ts")


def telemetry(spark, folder):
    return table(spark, folder, "events").select(
        F.col("ts").alias("timestamp"), F.col("user_id").alias("run_id"), F.col("event_id").alias("task_id"),
        F.col("event_type").alias("task_type"), F.floor(F.col("value") * 10).cast("int").alias("duration_ms"),
        (F.col("event_type") != "error").cast("int").alias("success"),
        (1 + F.col("event_id") % 8).cast("int").alias("consumer_count"), k_of().alias("queue_length"),
        (F.col("event_id") % 3).cast("int").alias("priority"))


def scaling_actions(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        "event_id", "user_id", "event_type",
        F.when(kind == "purchase", "scale_up").when(kind == "error", "scale_down").otherwise("steady").alias("action"),
        (1 + F.col("event_id") % 20).cast("int").alias("to"),
        F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("value") - 50) / 50)).alias("score"), "ts")


def hourly_stats(spark, folder):
    hour = F.date_trunc("hour", F.col("ts"))
    return table(spark, folder, "events").groupBy(hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"),
        F.max("value").alias("top"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    ).select(
        "hour", "n", "errors",
        F.greatest(F.lit(0.0), (F.round("total", 6) - 500) * 2).alias("backlog"),
        (F.round("mean", 6) / 50).alias("latency"), F.least(F.lit(1.0), F.col("n") / 20).alias("cpu"),
        (F.col("top") / 10).alias("p95"),
        (1 - F.col("errors") / F.col("n")).alias("success_rate"))


def tasks(spark, folder):
    status = F.col("o_orderstatus")
    rest = F.col("o_orderkey") % 3
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.concat(F.lit("type_"), (F.col("o_orderkey") % 5).cast("string")).alias("task_type"),
        F.when(F.col("o_custkey") % 4 == 0, F.lit(None)).otherwise(
            (F.col("o_custkey") % 10).cast("string")).alias("tenant"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 200).when(F.col("o_orderpriority") == "2-HIGH", 100)
        .when(F.col("o_orderpriority") == "5-LOW", 10).otherwise(50).alias("priority"),
        F.when(status == "F", "completed").when(status == "O", "pending").when(rest == 0, "reserved")
        .when(rest == 1, "dead").otherwise("failed").alias("status"),
        (F.col("o_orderkey") % 7).cast("int").alias("attempts"), F.col("o_orderdate").alias("created_at"))


def inflight(spark, folder):
    return tasks(spark, folder).filter(
        (F.col("status") == "reserved") | ((F.col("status") == "pending") & (F.col("task_id") % 10 == 0))
    ).select("task_id", (F.col("created_at") + F.expr("INTERVAL 60 SECONDS")).alias("deadline"))


def dlq(spark, folder):
    return tasks(spark, folder).filter(F.col("status") == "dead")


def usage(spark, folder):
    li = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("customer_id"), F.col("l_returnflag").alias("metric"),
        F.floor("l_quantity").cast("long").alias("quantity"), F.col("l_shipdate").alias("ts"))


def invoices(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("paid"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("total_cents"))


def invoice_lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("invoice_id"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long").alias("amount_cents"),
        F.floor("l_quantity").cast("long").alias("quantity"))


def subscriptions(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("plan_id"),
        F.col("c_acctbal").alias("balance"))


# Fixed plan rows: plan, price per month, included quota, price per unit over it.
PLANS = [("AUTOMOBILE", 29.0, 100, 0.05), ("BUILDING", 49.0, 500, 0.04), ("FURNITURE", 0.0, 0, 0.10),
         ("HOUSEHOLD", 99.0, 1000, 0.02), ("MACHINERY", 199.0, 2000, 0.01)]


def plans(spark):
    return spark.createDataFrame(PLANS, "plan_id string, price double, quota long, overage double")


def model_runs(spark, folder):
    day = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(p_partkey % 20000 AS INT))")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("version_id"), F.col("p_brand").alias("model_type"),
        (F.col("p_size") / 10.0).alias("rmse"), day.alias("created_at"),
        (F.col("p_size") % 2 == 0).alias("active"), (F.col("p_size") * 5).alias("n_samples"),
        (F.col("p_partkey") % 101).cast("double").alias("score"), F.col("p_name").alias("name"))


def workers(spark, folder):
    turn = F.col("s_suppkey") % 4
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("worker_id"),
        F.concat(F.lit("w"), (F.col("s_nationkey") % 3).cast("string")).alias("worker_type"),
        F.when(turn < 2, "running").when(turn == 2, "crashed").otherwise("stopped").alias("status"),
        (F.col("s_suppkey") % 7).cast("int").alias("restarts"),
        (F.col("s_suppkey") % 3).cast("int").alias("exit_code"),
        F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(s_suppkey AS INT))").alias("started_at"))


def experiments(spark, folder):
    kind = F.col("event_type")
    fault = F.col("event_id") % 3
    return table(spark, folder, "events").select(
        F.col("event_id").alias("experiment_id"),
        F.when(fault == 0, "latency").when(fault == 1, "kill").otherwise("cpu").alias("fault"),
        F.concat(F.lit("ns"), (F.col("user_id") % 3).cast("string")).alias("namespace"),
        F.col("user_id").alias("target"),
        F.when(kind == "view", "running").when(kind == "click", "pending").otherwise("completed").alias("status"),
        F.col("ts").alias("started_at"), F.floor(F.col("value") * 60).cast("long").alias("duration_seconds"))


def run_log(spark, folder):
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("t"), F.col("role").alias("node"),
        (F.length("text") / 100.0).alias("reward"))


def graph_nodes(spark, folder):
    region = table(spark, folder, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"), F.col("r_regionkey").alias("workflow"),
        F.lit("start").alias("kind"), F.lit(None).cast("string").alias("template"))
    nation = table(spark, folder, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.col("n_regionkey"), F.lit("task"),
        F.when(F.col("n_nationkey") % 6 != 0, F.col("n_name")))
    sup = (table(spark, folder, "supplier")
           .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
           .filter(F.col("s_suppkey") % 11 != 0)
           .select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.col("n_regionkey"), F.lit("task"),
                   F.col("s_name")))
    return region.unionAll(nation).unionAll(sup)


def graph_edges(spark, folder):
    """Region to nation to supplier; region 0 also gets an edge back to its root."""
    nation = table(spark, folder, "nation")
    down = nation.select(
        F.col("n_regionkey").alias("workflow"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"),
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"))
    leaf = (table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_regionkey"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")),
                    F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    back = nation.filter(F.col("n_regionkey") == 0).select(
        F.col("n_regionkey"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.lit("r0"))
    return down.unionAll(leaf).unionAll(back)
