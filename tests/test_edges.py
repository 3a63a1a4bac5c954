"""Rows that break naive code: NaN, infinity, no baseline, no configuration, fractions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from queuelens.operators import aggregates as ag
from queuelens.operators import ordered as od
from queuelens.operators import rows as rw

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("rows_of_a_slice", [2, 10**6])
def test_fractions_are_kept(spark, rows_of_a_slice):
    rows = [(i, "k", 10 * i, x) for i, x in enumerate([1.9, 2.2, None, NAN, 0.001, 2_500_000.125])]
    df = spark.createDataFrame(rows, "id long, key string, s long, duration_ms double").withColumns(
        {"timestamp": F.timestamp_seconds("s"), "queue_length": F.lit(1.5)})
    out = {r["id"]: r for r in od.rolling_features(df, ["key"], (25,), slice_rows=rows_of_a_slice).collect()}
    assert out[0]["dur_mean_25"] == 1.9 and out[1]["dur_mean_25"] == pytest.approx(2.05) and out[1]["dur_std_25"] == pytest.approx(0.3 / math.sqrt(2))
    assert out[3]["dur_count_25"] == 1 and out[4]["dur_mean_25"] == 0.001 and out[5]["dur_mean_25"] == pytest.approx(1_250_000.063)
    assert all(r["queue_mean_25"] == 1.5 for r in out.values())
    with pytest.raises(Exception, match="too large for scale"):
        od.rolling_features(df.withColumn("queue_length", F.lit(4e6)), ["key"], (25,)).collect()


def test_not_a_number_in_anomalies(spark):
    rows = [(i, 60 * i, x) for i, x in enumerate([1.0, 3.0, NAN, INF, None, 2.0, 100.0])]
    df = spark.createDataFrame(rows, "key long, s long, value double").withColumns({"ts": F.timestamp_seconds("s"), "name": F.lit(None).cast("string")})
    out = {r["key"]: r for r in od.anomaly_flags(df, ["name"], 3600, 50.0, 3.0).collect()}
    assert len(out) == 7 and out[5]["z"] == pytest.approx(0.0) and out[6]["over"] and out[6]["z_anomaly"]
    assert out[6]["z"] == pytest.approx(98 / math.sqrt(2 / 3), rel=1e-6)


def test_not_a_number_is_the_largest_value(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, NAN, 2.0, INF, None)] + [(None, 5.0)], "name string, value double").withColumn(
        "ts", F.timestamp_seconds(F.lit(100)))
    out = {r["name"]: r for r in ag.recent_stats(df, 1000, F.timestamp_seconds(F.lit(200))).collect()}
    assert out[None]["p90"] == 5.0 and out["a"]["count"] == 5 and out["a"]["p90"] == INF


def test_drift_maps_are_all_counted(spark):
    df = spark.range(12_000).select(F.timestamp_seconds("id").alias("ts"), F.create_map(F.lit("f"), F.col("id").cast("double")).alias("per_feature"))
    assert ag.drift_event_stats(df, F.timestamp_seconds(F.lit(0))).first()["count"] == 12_000


def test_promotion_without_a_baseline(spark):
    runs = spark.createDataFrame([("a", 1.0, 100), ("b", 1.0, 100)], "kind string, rmse double, n_samples long")
    base = spark.createDataFrame([("a", None)], "kind string, rmse double")
    out = {r["kind"]: (r["reason"], r["promote"]) for r in rw.promotion_decision(runs, base, "kind").collect()}
    assert out == {"a": ("baseline_missing", False), "b": ("no_promotion_condition_met", False)}


def test_a_run_without_configuration(spark):
    names = ("gamma double, lam double, lr double, steps_per_epoch int, use_clipped_value_loss boolean, value_coef double, normalize_advantages boolean, "
             "normalize_observations boolean, normalize_rewards boolean, max_grad_norm double")
    out = rw.config_stability(spark.createDataFrame([(None,) * 10], names)).first()
    assert (out["stability_score"], out["stable"], out["issues"]) == (80.0, True, "config_missing")
