"""Chains of operators that answer a whole request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.operators.aggregates import bucket_aggregate
from queuelens.operators.ordered import latency_bucket, rolling_features
from queuelens.operators.rows import basic_clean, feature_matrix, label_filter, time_range


def metric_query(points: DataFrame, name: str, start, end, labels: dict[str, str] | None = None, seconds: int = 60) -> DataFrame:
    """Buckets of one metric over a range, by labels; no row limit."""
    kept = time_range(points.filter(F.col("name") == name), start, end)
    return bucket_aggregate(label_filter(kept, labels or {}), seconds, ()).orderBy("window_start")


def training_set(raw: DataFrame, by: Sequence[str], id_col: str, label: str = "fail", windows: Sequence[int] = (60, 300),
                 time_col: str = "timestamp", as_of: Column | None = None) -> DataFrame:
    """Telemetry cleaned, with rolling features and a label, as a feature matrix."""
    clean = basic_clean(raw, time_col, as_of)
    rolled = rolling_features(clean, by, windows, "ts")
    marked = (rolled.withColumn("label_value", 1 - F.col("success")) if label == "fail"
              else latency_bucket(rolled, "duration_ms", id_col, 5, "label_value"))
    feats = ["queue_length", "consumer_count", "priority"] + [c for c in marked.columns if c.split("_")[-1].isdigit()]
    return feature_matrix(marked, feats, "label_value", [id_col])
