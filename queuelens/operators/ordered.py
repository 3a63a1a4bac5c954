"""Window functions and ordered computations.

Everything that runs over raw rows of a key goes through ``slices`` or
``scans``, which cut keys by the number of their rows; a plain window is used
only where Spark limits each group before the shuffle (``row_number() <= n``
with a small n). ``slice_rows`` is the number of rows one task is meant to hold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelens.operators.orderstats import beside_keys, boundary_rows, order_stats, position
from queuelens.operators.machines import Cooldown, Hysteresis, Machine, ShareBreaker, StreakBreaker, TokenBucket, WindowBreaker
from queuelens.operators.scans import affine_scan, machine_scan
from queuelens.operators.slices import SLICE_ROWS, deviation, limit_early, micros, prefix_frame, row_frame, sweep_frame
from queuelens.operators.scalars import beside
from queuelens.session import cut_lineage

GROUP_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold default


# --- rolling features and labels ----------------------------------------

def rolling_features(df: DataFrame, by: Sequence[str], windows: Sequence[int] = (60, 300), ts: str = "timestamp",
                     slice_rows: int = SLICE_ROWS, scale: int = 1000) -> DataFrame:
    """Mean, deviation, count of duration and mean, deviation of queue length
    over ``(t - w, t]`` per key; missing values are 0.

    Values are taken to ``1 / scale``, as whole numbers, so that sums are exact;
    a value times ``scale`` may be up to 3e9, beyond that an error is raised. NaN
    counts as missing.
    """
    def whole(c: str) -> Column:
        x = F.col(c).cast("double")
        fits = F.round(x * scale).cast("long")
        checked = F.when(F.abs(x * scale) > 3e9, F.raise_error(F.concat(F.lit(f"{c} is too large for scale {scale}: "), x.cast("string"))).cast("long")).otherwise(fits)
        return F.when(~F.isnan(x), checked)

    dur, queue = whole("duration_ms"), whole("queue_length")
    out = sweep_frame(df, by, ts, {f"_w{w}": (w * 1_000_000 - 1, 0) for w in windows}, {
        "dn": dur.isNotNull(), "ds": F.coalesce(dur, F.lit(0)), "qn": queue.isNotNull(), "qs": F.coalesce(queue, F.lit(0))},
        {"dq": F.coalesce(dur, F.lit(0)), "qq": F.coalesce(queue, F.lit(0))}, slice_rows)
    made = {}
    for w in windows:
        c = lambda x: F.col(f"_w{w}_{x}")
        for name, tag in (("dur", "d"), ("queue", "q")):
            mean = c(f"{tag}s").cast("double") / F.nullif(c(f"{tag}n").cast("double"), F.lit(0.0))
            made[f"{name}_mean_{w}"] = F.coalesce(mean / scale, F.lit(0.0))
            made[f"{name}_std_{w}"] = F.coalesce(deviation(c(f"{tag}n"), c(f"{tag}s"), c(f"{tag}q"), True) / scale, F.lit(0.0))
        made[f"dur_count_{w}"] = c("dn").cast("long")
    return out.select(*df.columns, *[v.alias(k) for k, v in made.items()])


def _above(value: str, tie: str, pair) -> Column:
    """Row lies after the boundary pair in (value, tie) order."""
    if pair is None:
        return F.lit(False)
    v, t = F.col(value).cast("double"), F.col(tie)
    return (v > pair[0]) | ((v == pair[0]) & (t > pair[1]))


def latency_bucket(df: DataFrame, value: str, tie: str, buckets: int = 5, name: str = "bucket") -> DataFrame:
    """Bucket ``max(ceil((r-1) * q / (n-1)) - 1, 0)`` of the rank r.

    The rank itself is never formed: bucket k starts after the row at position
    ``floor(k * (n-1) / q)``, and those few rows are found by counting.
    """
    cuts = {f"_b{k}": (lambda n, k=k: F.floor(F.lit(k) * (n - 1) / F.lit(buckets))) for k in range(1, buckets)}
    edges = boundary_rows(df, value, tie, cuts)
    label = sum((F.coalesce(_above(value, tie, edges[c]), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    return df.withColumn(name, label)


def next_value_label(df: DataFrame, key: str, order: Sequence[str], value: str, tie: str,
                     buckets: int = 5, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Bucket of the next value in the same run (its own value at the end)."""
    nxt = row_frame(df, [key], order, lambda s: {
        "next_value": F.coalesce(F.lead(value).over(s), F.col(value))}, after=1, slice_rows=slice_rows)
    return latency_bucket(cut_lineage(nxt), "next_value", tie, buckets, "label")


def fail_label(df: DataFrame, success: str = "success") -> DataFrame:
    return df.withColumn("label", 1 - F.col(success))


def horizon_targets(steps: DataFrame, keys: Sequence[str], order: Sequence[str], horizon: int,
                    rate: float, step: float = 1.0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Next backlog, highest backlog of the horizon, and the burst flag."""
    h = max(1, math.ceil(horizon / step))
    limit = max(1, int(rate * step * 2))
    out = row_frame(steps, keys, order, lambda s: {
        "target_next_step": F.coalesce(F.lead("backlog", 1).over(s), F.lit(0)),
        "target_horizon_max": F.coalesce(F.max("backlog").over(s.rowsBetween(1, h)), F.lit(0))}, after=h, slice_rows=slice_rows)
    return out.withColumn("target_binary_burst", (F.col("target_horizon_max") >= limit).cast("int"))


# --- newest rows and versions -------------------------------------------

def latest_per_key(df: DataFrame, key: str, order: Sequence[str], where: Column | None = None,
                   prefer: Sequence[Column] = ()) -> DataFrame:
    """Newest row per key among those kept; rows meeting ``prefer`` come first."""
    kept = df.filter(where) if where is not None else df
    ranks = [F.coalesce(p, F.lit(False)).desc() for p in prefer] + [F.col(c).desc() for c in order]
    spec = Window.partitionBy(key).orderBy(*ranks)
    return kept.withColumn("_r", F.row_number().over(spec)).filter("_r = 1").drop("_r")


def version_history(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Write number of each row within its key."""
    return prefix_frame(df, keys, order, {"version": F.lit(1)}, slice_rows=slice_rows)


def nth_previous(history: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The version ``n`` before the newest of each key."""
    newest = history.groupBy(*keys).agg(F.max("version").alias("_top"))
    return history.join(newest, list(keys)).filter(F.col("version") == F.col("_top") - n).drop("_top")


def rollback(history: DataFrame, keys: Sequence[str], version: int, as_of, ts: str = "ts") -> DataFrame:
    """Copy of ``version`` written as the newest, for each key that has it."""
    newest = history.groupBy(*keys).agg(F.max("version").alias("_top"))
    copy = (history.filter(F.col("version") == version).join(newest, list(keys))
            .withColumn("version", F.col("_top") + 1).withColumn(ts, F.lit(as_of)).drop("_top"))
    return history.unionByName(copy)


def keep_last_n(df: DataFrame, n: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Only the newest n rows, overall or per key.

    Few rows per key come from a window that Spark limits before the shuffle,
    few rows overall from a top-n; for many rows the row at the cut is found by
    counting and the others are compared with it. ``order`` is (time, unique id).
    """
    ts, tie = order
    if n <= GROUP_LIMIT:
        if not keys:
            return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
        spec = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
        return df.withColumn("_r", F.row_number().over(spec)).filter(F.col("_r") <= n).drop("_r")
    timed = df.withColumn("_us", micros(ts))
    if not keys:
        pair = boundary_rows(timed, "_us", tie, {"cut": lambda m: F.greatest(m - n, F.lit(0))})["cut"]
        if pair is None:
            return df
        us = F.col("_us")
        return timed.filter((us > pair[0]) | ((us == pair[0]) & (F.col(tie) >= pair[1]))).drop("_us")
    cut = order_stats(timed, keys, "_us", {"_cut": lambda m: F.greatest(m - n, F.lit(0))})
    placed = timed.join(cut, list(keys))
    newer = placed.filter(F.col("_us") > F.col("_cut")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_newer"))
    at_cut = placed.filter(F.col("_us") == F.col("_cut")).join(newer, list(keys), "left").fillna(0, ["_newer"])
    spec = Window.partitionBy(*keys).orderBy(F.col(tie).desc())
    tied = at_cut.withColumn("_r", F.row_number().over(spec)).filter(F.col("_r") <= n - F.col("_newer"))
    return placed.filter(F.col("_us") > F.col("_cut")).select(*df.columns).unionByName(tied.select(*df.columns))


# --- running statistics --------------------------------------------------

def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, w: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    return row_frame(df, keys, order, lambda s: {
        "moving_avg": F.avg(value).over(s.rowsBetween(-(w - 1), 0))}, before=w - 1, slice_rows=slice_rows)


def ewma(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.3,
         slice_rows: int = SLICE_ROWS) -> DataFrame:
    """v = a * x + (1 - a) * v, starting at the first value."""
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    marked = beside_keys(df, firsts, list(keys)).withColumn("_is_first", F.struct(*order) == F.col("_first")).drop("_first")
    x = F.col(value)
    out = affine_scan(marked, keys, order, F.when(F.col("_is_first"), 0.0).otherwise(1.0 - alpha),
                      F.when(F.col("_is_first"), x).otherwise(x * alpha), "ewma", slice_rows=slice_rows)
    return out.drop("_is_first")


def running_normalize(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                      clip: float = 10.0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(x - mean) / sqrt(variance + 1e-8) with the statistics up to this row.

    Values are centred on the overall mean first, so that the running sum of
    squares keeps its digits.
    """
    centre = df.agg(F.avg(value).alias("_c"))
    rows = beside(df, centre).withColumn("_x", F.col(value) - F.col("_c"))
    run = prefix_frame(rows, keys, order, {
        "_n": F.lit(1), "_s": F.col("_x"), "_q": F.col("_x") * F.col("_x")}, slice_rows=slice_rows)
    mean = F.col("_s") / F.col("_n")
    var = F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))
    z = F.when(F.col("_n") == 1, F.lit(0.0)).otherwise((F.col("_x") - mean) / F.sqrt(var + 1e-8))
    return run.withColumn("normalized", F.greatest(F.lit(-clip), F.least(F.lit(clip), z))).drop("_n", "_s", "_q", "_x", "_c")


def cumulative(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    return prefix_frame(df, keys, order, {f"{value}_cumulative": F.col(value)}, slice_rows=slice_rows)


# --- anomalies, limits, drift -------------------------------------------

def anomaly_flags(points: DataFrame, keys: Sequence[str], window_s: int = 600, threshold: float = 1e9, z_limit: float = 5.0,
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each point against a fixed threshold and against its trailing window.

    The z value uses earlier points only; with none of them there is no anomaly.
    Values are taken to nine digits of their key's largest one, as whole numbers;
    nulls, NaN and infinite values are no part of any window.
    """
    finite = F.abs("value") < float("inf")  # NaN sorts above infinity
    tops = points.groupBy(*keys).agg(F.max(F.when(finite & (F.col("value") != 0), F.abs("value"))).alias("_top"))
    scaled = beside_keys(points, tops, list(keys)).withColumn(
        "_unit", F.pow(F.lit(10.0), 9 - F.ceil(F.log10(F.coalesce("_top", F.lit(1.0))) + 1e-12))).drop("_top")
    unit, whole = F.col("_unit"), F.when(finite, F.round(F.col("value") * F.col("_unit"))).cast("long")
    out = sweep_frame(scaled, keys, "ts", {"_w": (window_s * 1_000_000, -1)},
                      {"s": whole, "c": whole.isNotNull().cast("long")}, {"q": whole}, slice_rows)
    mean = F.col("_w_s").cast("double") / F.nullif(F.col("_w_c").cast("double"), F.lit(0.0)) / unit
    std = deviation(F.col("_w_c"), F.col("_w_s"), F.col("_w_q"), False) / unit
    z = F.abs(F.col("value") - mean) / (std + 1e-9)
    return out.select(*points.columns, (F.col("value") > threshold).alias("over"), F.coalesce(z, F.lit(0.0)).alias("z"),
                      F.coalesce(z > z_limit, F.lit(False)).alias("z_anomaly"))


def anomaly_latest(points: DataFrame, keys: Sequence[str], as_of, window_s: int = 600, k: float = 3.0) -> DataFrame:
    """The newest value of each key against the quartiles of its window."""
    recent = points.filter((F.col("ts") <= F.lit(as_of)) & (F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {int(window_s)} SECONDS")))
    last = recent.groupBy(*keys).agg(F.max_by("value", F.struct("ts", "key")).alias("last"), F.count(F.lit(1)).alias("n"))
    quart = order_stats(recent, keys, "value", {"q1": position(0.25), "q3": position(0.75)})
    upper = F.col("q3") + k * (F.col("q3") - F.col("q1"))
    return last.join(quart, list(keys)).withColumn("upper", upper).withColumn("iqr_anomaly", F.col("last") > F.col("upper"))


def rate_limit_flags(df: DataFrame, keys: Sequence[str], limit: int = 3, window_s: int = 300, ts: str = "ts",
                     slice_rows: int = SLICE_ROWS) -> DataFrame:
    """More than ``limit`` actions in the last ``window_s`` seconds, this one included."""
    out = sweep_frame(df, keys, ts, {"_w": (window_s * 1_000_000, 0)}, {}, None, slice_rows)
    return out.withColumnRenamed("_w_n", "in_window").withColumn("limited", F.col("in_window") > limit)


def baseline_drift(df: DataFrame, keys: Sequence[str], order: Sequence[str], obs: str, reward: str,
                   w: int, limit: float = 0.3, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Shift of the last w rows against the first w rows, once both are full."""
    limit_early(df, w)
    spec = Window.partitionBy(*keys).orderBy(*order)
    first = (df.withColumn("_r", F.row_number().over(spec)).filter(F.col("_r") <= w).groupBy(*keys)
             .agg(F.avg(obs).alias("_bo"), F.stddev_pop(obs).alias("_so"), F.avg(reward).alias("_br"), F.stddev_pop(reward).alias("_sr")))
    run = row_frame(df, keys, order, lambda s: {
        "_mo": F.avg(obs).over(s.rowsBetween(-(w - 1), 0)), "_mr": F.avg(reward).over(s.rowsBetween(-(w - 1), 0)),
        "_n": F.count(F.lit(1)).over(s.rowsBetween(-(w - 1), 0))}, before=w - 1, slice_rows=slice_rows)
    full = run.filter(F.col("_n") == w).join(first, list(keys))
    score = F.greatest(F.abs(F.col("_mo") - F.col("_bo")) / (F.col("_so") + 1e-8),
                       F.abs(F.col("_mr") - F.col("_br")) / (F.col("_sr") + 1e-8))
    return full.withColumn("drift_score", score).withColumn("drift", F.col("drift_score") > limit).drop(
        "_mo", "_mr", "_n", "_bo", "_so", "_br", "_sr")


def improvement_reward(snaps: DataFrame, keys: Sequence[str], order: Sequence[str], sla: float = 1.0,
                       slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Reward of each snapshot against the one before it; none for the first."""
    out = row_frame(snaps, keys, order, lambda s: {"_p": F.lag("p95").over(s), "_b": F.lag("backlog").over(s)}, before=1,
                    slice_rows=slice_rows)
    gain = (F.greatest(F.lit(0.0), F.col("_p") - F.col("p95")) + 0.2 * F.greatest(F.lit(0.0), F.col("_b") - F.col("backlog"))
            - F.when(F.col("p95") > sla, (F.col("p95") - sla) * 2.0).otherwise(0.0))
    return out.withColumn("reward", F.when(F.col("_p").isNull(), F.lit(0.0)).otherwise(gain) - 0.1 * F.abs("delta")).drop("_p", "_b")


# --- scaling history -----------------------------------------------------

def oscillation(actions: DataFrame, keys: Sequence[str], order: Sequence[str], last: int = 5, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The last actions hold both directions."""
    seen = lambda s, a: F.max(F.when(F.col("action") == a, 1).otherwise(0)).over(s.rowsBetween(-(last - 1), 0))
    out = row_frame(actions, keys, order, lambda s: {"_u": seen(s, "scale_up"), "_d": seen(s, "scale_down")}, before=last - 1,
                    slice_rows=slice_rows)
    return out.withColumn("oscillating", (F.col("_u") == 1) & (F.col("_d") == 1)).drop("_u", "_d")


def stall_gaps(actions: DataFrame, keys: Sequence[str], order: Sequence[str], gap_s: float, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows after which nothing happened for more than ``gap_s`` seconds."""
    out = row_frame(actions, keys, order, lambda s: {"_next": F.lead(micros(order[0])).over(s)}, after=1, slice_rows=slice_rows)
    gap = (F.col("_next") - micros(order[0])) / 1e6
    return out.withColumn("gap_s", gap).filter(F.col("gap_s") > gap_s).drop("_next")


def dlq_growth(depth: DataFrame, min_dlq: int = 500, max_backlog: int = 50) -> DataFrame:
    return depth.filter((F.col("dlq") > min_dlq) & (F.col("pending") < max_backlog))


# --- state machines ------------------------------------------------------

def hysteresis(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, band: float = 0.15,
               slice_rows: int = SLICE_ROWS) -> DataFrame:
    """A score close to the kept one keeps it; then up, down or steady. Rows without a score are left out."""
    x = F.col(score).cast("double")
    out = machine_scan(df, keys, order, Hysteresis(band), {"x": F.when(~F.isnan(x), x)}, {"kept_score": "double"}, slice_rows)
    kept = F.col("kept_score")
    return out.withColumn("kept_action", F.when(kept > band, "scale_up").when(kept < -band, "scale_down").otherwise("steady"))


def cooldown_filter(df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: float, ts: str = "ts",
                    slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows that may act: none acted in the last ``seconds``."""
    out = machine_scan(df, keys, order, Cooldown(int(seconds * 1_000_000)), {"t": micros(ts)}, {"_act": "boolean"}, slice_rows)
    return out.filter("_act").drop("_act")


def token_bucket(df: DataFrame, keys: Sequence[str], order: Sequence[str], rate: float, capacity: float, ts: str = "ts",
                 slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Refill at ``rate`` per second up to ``capacity``; each request spends one.

    Exact in whole numbers: a token takes ``1e6 / rate`` microseconds, taken as the nearest fraction with a
    denominator of up to a million.
    """
    return machine_scan(df, keys, order, TokenBucket(rate, capacity), {"t": micros(ts)}, {"allowed": "boolean"}, slice_rows)


def breaker(variant: str = "streak", **cfg) -> Machine:
    """The machine of a circuit breaker: ``streak``, ``window`` or ``share``."""
    if variant == "window":
        return WindowBreaker(cfg.get("threshold", 5), cfg.get("window_s", 300) * 1_000_000)
    if variant == "share":
        return ShareBreaker(cfg.get("threshold", 50), cfg.get("window_s", 120) * 1_000_000, cfg.get("share", 0.7), cfg.get("recover", 10))
    return StreakBreaker(cfg.get("trip", 5), int(cfg.get("open_s", 30) * 1_000_000), cfg.get("successes", 3))


def circuit_breaker(df: DataFrame, keys: Sequence[str], order: Sequence[str], variant: str = "streak", ok: str = "ok", ts: str = "ts",
                    slice_rows: int = SLICE_ROWS, **cfg) -> DataFrame:
    """State after each request and whether it was let through. A request without an outcome failed."""
    made = {"state": "string", "allowed": "boolean"}
    inputs = {"t": micros(ts), "ok": F.coalesce(F.col(ok), F.lit(False))}
    if variant != "share":
        return machine_scan(df, keys, order, breaker(variant, **cfg), inputs, made, slice_rows)
    span = cfg.get("window_s", 120) * 1_000_000
    swept = cut_lineage(sweep_frame(df, keys, ts, {"_w": (span - 1, 0)}, {"oks": F.coalesce(F.col(ok), F.lit(False))}, None, slice_rows))
    inputs |= {"fails": F.col("_w_n") - F.col("_w_oks"), "oks": F.col("_w_oks")}
    return machine_scan(swept, keys, order, breaker(variant, **cfg), inputs, made, slice_rows).drop("_w_n", "_w_oks")


def gae(steps: DataFrame, key: str, order: Sequence[str], gamma: float = 0.99, lam: float = 0.95,
        normalize: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Advantages from the last step of an episode back to its first, and returns."""
    ahead = row_frame(steps, [key], order, lambda s: {"_next": F.coalesce(F.lead("value").over(s), F.lit(0.0))}, after=1,
                      slice_rows=slice_rows)
    live = 1.0 - F.col("done").cast("double")
    delta = F.col("reward") + gamma * F.col("_next") * live - F.col("value")
    out = affine_scan(ahead, [key], order, live * (gamma * lam), delta, "advantage", descending=True, slice_rows=slice_rows)
    out = out.withColumn("returns", F.col("advantage") + F.col("value")).drop("_next")
    if not normalize:
        return out
    scale = out.agg(F.avg("advantage").alias("_m"), F.stddev_samp("advantage").alias("_s"))
    return beside(out, scale).withColumn(
        "advantage", (F.col("advantage") - F.col("_m")) / (F.coalesce("_s", F.lit(0.0)) + 1e-8)).drop("_m", "_s")
