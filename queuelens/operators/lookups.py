"""Joins. All are keyed; small sides are left to the
optimizer, which broadcasts them when their size is known to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.session import cut_lineage


def estimate_invoices(customers: DataFrame, subs: DataFrame, plans: DataFrame, usage: DataFrame, as_of, days: int = 30,
                      tax_percent: float = 10.0) -> DataFrame:
    """Plan price plus overage on the usage of the last days, with tax.

    No overage when the quota is 0. Tax is not rounded here.
    """
    used = (usage.filter((F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("ts") <= F.lit(as_of)))
            .groupBy("customer_id").agg(F.sum("quantity").alias("usage_total")))
    rows = (customers.select("customer_id").join(subs.select("customer_id", "plan_id"), "customer_id", "left")
            .join(plans, "plan_id", "left").join(used, "customer_id", "left").fillna(0, ["usage_total"]))
    extra = F.when(F.col("quota") > 0, F.greatest(F.lit(0), F.col("usage_total") - F.col("quota")) * F.col("overage")
                   ).otherwise(F.lit(0.0))
    sub = F.coalesce("price", F.lit(0.0)) + F.coalesce(extra, F.lit(0.0))
    tax = sub * (tax_percent / 100.0)
    return rows.select("customer_id", "usage_total", sub.alias("subtotal"), tax.alias("tax"), (sub + tax).alias("total"))


def sla_violations(runs: DataFrame, nodes: DataFrame, as_of) -> DataFrame:
    """Running runs with a node of their workflow whose limit has passed."""
    elapsed = (F.unix_micros(F.lit(as_of)) - F.unix_micros("started_at")) / 1e6
    live = runs.filter(F.col("status") == "running").withColumn("elapsed", elapsed)
    return (live.join(nodes.filter(F.col("sla_seconds") > 0), "workflow_id").filter(F.col("elapsed") > F.col("sla_seconds"))
            .select("run_id", "node_id", "sla_seconds", "elapsed"))


def resolve_overrides(orgs: DataFrame, config: DataFrame, overrides: DataFrame) -> DataFrame:
    """Value of each (org, key): the org's own if present, else the global one."""
    own = overrides.select("org", "key", F.col("value").alias("_own"))
    base = config.select("key", F.col("value").alias("_base"))
    return orgs.join(own, ["org", "key"], "left").join(base, "key", "left").select(
        "org", "key", F.coalesce("_own", "_base").alias("value"),
        F.when(F.col("_own").isNotNull(), "org").when(F.col("_base").isNotNull(), "global").otherwise("none").alias("source"))


def policy_check(exps: DataFrame, policies: DataFrame) -> DataFrame:
    """Allowed or blocked per experiment, with the first reason that applies.

    Policies are expanded to (fault, namespace) pairs and reduced to the
    strictest limits, so experiments meet them by equality: once for their own
    namespace and once for ``*``.
    """
    pairs = (policies.select(F.explode("faults").alias("fault"), "namespaces", "max_concurrent", "max_duration")
             .select("fault", F.explode("namespaces").alias("namespace"), "max_concurrent", "max_duration")
             .groupBy("fault", "namespace").agg(F.min("max_concurrent").alias("c"), F.min("max_duration").alias("d")))
    own = pairs.filter(F.col("namespace") != "*").withColumnsRenamed({"c": "_c1", "d": "_d1"})
    wild = pairs.filter(F.col("namespace") == "*").select("fault", F.col("c").alias("_c2"), F.col("d").alias("_d2"))
    active = (exps.filter(F.col("status").isin("running", "pending")).groupBy("target")
              .agg(F.count(F.lit(1)).alias("_active")))
    joined = (exps.join(own, ["fault", "namespace"], "left").join(wild, "fault", "left").join(active, "target", "left")
              .fillna(0, ["_active"]))
    limit, span = F.least("_c1", "_c2"), F.least("_d1", "_d2")  # nulls are skipped
    reason = (F.when(limit.isNull(), "no_policy_allows_fault").when(F.col("_active") >= limit, "concurrent_limit_reached")
              .when(F.col("duration_seconds") > span, F.concat(F.lit("duration_exceeds_policy_max ("), span.cast("string"), F.lit("s)"))))
    return joined.select("experiment_id", reason.isNull().alias("allowed"), reason.alias("reason"))


def invalid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an unknown end, and task nodes without a template."""
    known = nodes.select("workflow", "node_id")
    bad = lambda end, issue: edges.join(known.withColumnRenamed("node_id", end), ["workflow", end], "left_anti").select(
        "workflow", F.concat_ws("->", "src", "dst").alias("item"), F.lit(issue).alias("issue"))
    bare = nodes.filter((F.col("kind") == "task") & F.col("template").isNull()).select(
        "workflow", F.col("node_id").alias("item"), F.lit("missing_template").alias("issue"))
    return bad("src", "unknown_source").unionAll(bad("dst", "unknown_target")).unionAll(bare)


def cyclic_workflows(links: DataFrame) -> DataFrame:
    """Workflows whose distinct links (workflow, src, dst) contain a cycle.

    Each round trims links that leave a node nothing enters or enter a node nothing leaves; what is left of a
    workflow that loses no link has a cycle, as every node leads on to another one, and a workflow without links
    has none: both are finished and dropped. Links into a node with a single way on are put through to its end, so
    chains halve every round: one of n nodes takes log2(n) rounds and not n. What remains slow is a graph that
    stays wide and deep at once (each node with several ways on): there a round takes off a layer at both ends.
    """
    spark = links.sparkSession
    found = spark.createDataFrame([], links.select("workflow").schema)
    left, before = links, links.groupBy("workflow").agg(F.count(F.lit(1)).alias("_before"))
    while not left.isEmpty():
        outs = left.groupBy("workflow", F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("_ways"), F.min("dst").alias("_way"))
        entered = left.select("workflow", F.col("dst").alias("src")).distinct()
        kept = cut_lineage(left.join(entered, ["workflow", "src"], "left_semi").join(outs, ["workflow", "dst"])
                           .select("workflow", "src", F.when(F.col("_ways") == 1, F.col("_way")).otherwise(F.col("dst")).alias("dst")))
        sizes = cut_lineage(kept.groupBy("workflow").agg(F.count(F.lit(1)).alias("_after")).join(before, "workflow"))
        found = found.unionByName(sizes.filter("_after = _before").select("workflow"))
        going = sizes.filter("_after < _before").select("workflow")
        left = cut_lineage(kept.join(going, "workflow", "left_semi").distinct())
        before = left.groupBy("workflow").agg(F.count(F.lit(1)).alias("_before"))
    return found


def dag_check(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per workflow: acyclic or not, start and end node counts, sizes. All graphs are worked on together."""
    links = cut_lineage(edges.select("workflow", "src", "dst").distinct())
    cyclic = cyclic_workflows(links).withColumn("_cyclic", F.lit(True))
    into = links.select("workflow", F.col("dst").alias("node_id")).distinct().withColumn("_in", F.lit(True))
    out = links.select("workflow", F.col("src").alias("node_id")).distinct().withColumn("_out", F.lit(True))
    marked = nodes.join(into, ["workflow", "node_id"], "left").join(out, ["workflow", "node_id"], "left")
    per = marked.groupBy("workflow").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("_in").isNull()).alias("start_nodes"),
        F.count_if(F.col("_out").isNull()).alias("end_nodes"))
    sizes = links.groupBy("workflow").agg(F.count(F.lit(1)).alias("edges"))
    return (per.join(sizes, "workflow", "left").join(cyclic, "workflow", "left")
            .select("workflow", F.col("_cyclic").isNull().alias("acyclic"), "nodes",
                    F.coalesce("edges", F.lit(0)).alias("edges"), "start_nodes", "end_nodes"))


def tree_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Status of each path of two manifests (path, size, sha256)."""
    a = left.select("path", F.col("size").alias("_s1"), F.col("sha256").alias("_h1"), F.lit(True).alias("_l"))
    b = right.select("path", F.col("size").alias("_s2"), F.col("sha256").alias("_h2"), F.lit(True).alias("_r"))
    return a.join(b, "path", "full_outer").select(
        "path", F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
        .when(~F.col("_s1").eqNullSafe(F.col("_s2")), "size_mismatch")
        .when(~F.col("_h1").eqNullSafe(F.col("_h2")), "hash_mismatch").otherwise("same").alias("status"))


def missing_refs(child: DataFrame, parent: DataFrame, on: Column | str | list) -> DataFrame:
    return child.join(parent, on, "left_anti")


def apply_payment_events(invoices: DataFrame, events: DataFrame) -> DataFrame:
    """Invoices after their payment events: the newest event decides ``paid``
    and ``status``, the newest success the amount."""
    order = F.struct("ts", "event_id")
    newest = events.groupBy("invoice_id").agg(
        F.max_by("type", order).alias("_type"),
        F.max_by("amount_cents", F.when(F.col("type") == "succeeded", order)).alias("paid_amount_cents"))
    ok = F.col("_type") == "succeeded"
    return invoices.join(newest, "invoice_id", "left").select(
        "invoice_id", F.coalesce(ok, F.col("paid")).alias("paid"),
        F.when(ok, "paid").when(F.col("_type") == "failed", "past_due").otherwise("open").alias("status"), "paid_amount_cents")


def apply_subscription_events(subs: DataFrame, events: DataFrame) -> DataFrame:
    """Status of each subscription from the newest event of its external id."""
    newest = events.groupBy("external_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("_new"))
    return subs.join(newest, "external_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def expired_inflight(inflight: DataFrame, tasks: DataFrame, as_of) -> DataFrame:
    """Entries past their deadline: reserved tasks return, others just leave."""
    due = inflight.filter(F.col("deadline") <= F.lit(as_of))
    return due.join(tasks.select("task_id", "status"), "task_id", "left").select(
        "task_id", F.when(F.col("status") == "reserved", "requeue").otherwise("drop").alias("action"),
        F.when(F.col("status") == "reserved", "pending").otherwise(F.col("status")).alias("status"))


def consumer_lag(committed: DataFrame, ends: DataFrame) -> DataFrame:
    """Entries behind per topic and group, over all partitions of the topic.

    A partition without a commit counts from 0.
    """
    groups = committed.select("topic", "group").distinct()
    return (groups.join(ends, "topic").join(committed, ["topic", "group", "partition"], "left")
            .groupBy("topic", "group").agg(
                F.sum(F.col("end_offset") - F.coalesce("offset", F.lit(0))).alias("lag"),
                F.count(F.lit(1)).alias("partitions")))


def new_versions(index: DataFrame, seen: DataFrame, condition: Column) -> DataFrame:
    return index.filter(condition).join(seen.select("version_id").distinct(), "version_id", "left_anti")
