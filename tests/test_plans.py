"""Physical plans: pushed filters, pruned columns, early limits, no cross products."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from queuelens import fixtures as fx
from queuelens.operators import aggregates as ag
from queuelens.operators import ordered as od
from queuelens.operators import rows as rw

QUERIES = entry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_range_reaches_the_scan(spark, data):
    out = rw.time_range(fx.table(spark, data, "events"), F.to_timestamp(F.lit("2024-01-19")), None).select("event_id")
    text = plan(out)
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_snapshot_bounds_reach_the_scan(spark, data):
    text = plan(ag.window_snapshot(fx.metric_points(spark, data), [60], F.to_timestamp(F.lit("2024-01-20"))))
    scans = re.findall(r"PushedFilters: \[([^\]]*)", text)
    assert scans and all("LessThan(ts" in s and "GreaterThanOrEqual(ts" in s for s in scans)


@pytest.mark.parametrize("key", ["priority_order", "latest_per_key", "keep_last_n", "upsert_latest", "append_idempotent_rows"])
def test_group_limit_runs_before_the_shuffle(spark, data, key):
    if key == "append_idempotent_rows":
        from queuelens.sources.sinks import unseen_rows
        ev = fx.table(spark, data, "events").select("event_id", "ts")
        df = unseen_rows(ev, ev, "event_id", F.current_timestamp())
    else:
        df = QUERIES[key](spark, data)
    assert re.search(r"WindowGroupLimit.*Partial", plan(df))


@pytest.mark.parametrize("key", ["window_snapshot", "rolling_features", "moving_average", "version_history", "rate_limit_flags", "estimate_invoices",
                                 "policy_check", "sla_violations", "tree_diff", "consumer_lag"])
def test_no_products(spark, data, key):
    text = plan(QUERIES[key](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


SLICED = {
    "moving_average": lambda ev: od.moving_average(ev, ["event_type"], ["ts", "event_id"], "value", 5, slice_rows=50),
    "rolling": lambda ev: od.rate_limit_flags(ev, ["event_type"], 3, 7200, slice_rows=50),
    "versions": lambda ev: od.version_history(ev, ["event_type"], ["ts", "event_id"], slice_rows=50),
    "drift": lambda ev: od.baseline_drift(ev, ["event_type"], ["ts", "event_id"], "value", "value", 5, slice_rows=50),
}


@pytest.mark.parametrize("key", SLICED)
def test_large_keys_are_partitioned_by_slice(spark, data, key):
    """Where a key is cut, windows over its rows run per slice, and the lists of cuts are broadcast."""
    text = plan(SLICED[key](fx.table(spark, data, "events")))
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", text)
    assert any("_slice" in w for w in windows) and "BroadcastHashJoin [_key" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("kind", ["cooldown", "ewma"])
def test_a_scan_reads_its_rows_twice(spark, data, kind):
    ev = fx.table(spark, data, "events").select("event_id", "event_type", "value", "ts")
    run = {"cooldown": lambda n: od.cooldown_filter(ev, ["event_type"], ["ts", "event_id"], 60, slice_rows=n),
           "ewma": lambda n: od.affine_scan(ev, ["event_type"], ["ts", "event_id"], F.lit(0.5), F.col("value"), "v", slice_rows=n)}[kind]
    assert plan(run(50)).count("Scan parquet") == 2 and plan(run(10**6)).count("Scan parquet") == 1


def test_labels_need_no_window(spark, data):
    df = od.latency_bucket(fx.telemetry(spark, data), "duration_ms", "task_id")
    assert "Window" not in plan(df) and "Exchange" not in plan(df)


def test_narrow_rules_do_not_shuffle(spark, data):
    for key in ("retry_decision", "top_contributors", "scale_hint", "config_stability", "normalize_observation", "backoff_schedule"):
        assert "Exchange" not in plan(QUERIES[key](spark, data)), key
