"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated keys, default the list below).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from queuelens import catalog  # noqa: E402
from queuelens.session import get_session  # noqa: E402

HEADLINE = [
    "bucket_aggregate", "rollup_series", "top_names", "window_snapshot", "histogram", "latency_heatmap_scaled", "usage_totals",
    "invoice_totals", "estimate_invoices", "queue_depth", "priority_order", "retry_decision", "fuse_scores", "rolling_features",
    "latency_bucket_label", "rate_limit_flags", "anomaly_flags", "moving_average", "ewma", "cooldown_filter", "circuit_breaker",
    "dataset_drift", "distribution_drift", "ab_statistics", "regression_metrics", "timing_summary", "dag_check", "tree_diff",
    "stream_rollup", "stream_sliding", "train_predictor", "token_bucket", "training_set", "train_val_test", "visibility_timeout", "upsert_latest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k] or HEADLINE
    spark = get_session(f"local[{cpus}]", int(cpus), "queuelens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    def run(key: str, where: str) -> None:
        queries[key](spark, where).write.format("noop").mode("overwrite").save()

    # each query first runs on the smallest tables, so that compiling its code is not timed
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    times = {}
    for key in keys:
        if os.path.isdir(small):
            run(key, small)
        start = time.perf_counter()
        run(key, folder)
        times[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}), flush=True)


if __name__ == "__main__":
    main()
