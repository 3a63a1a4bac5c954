"""Aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelens.operators.orderstats import beside_keys, linear_percentiles, order_stats, position
from queuelens.operators.scalars import beside

R = 6


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, R)


# --- metric points -------------------------------------------------------

def bucket_start(ts: str, seconds: int) -> Column:
    """Start of the epoch-aligned bucket that holds ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)) * seconds)


def bucket_aggregate(points: DataFrame, seconds: int = 60, by: Sequence[str] = ("name",)) -> DataFrame:
    """Count, mean, min and max of each time bucket."""
    return points.groupBy(bucket_start("ts", seconds).alias("window_start"), *by).agg(
        F.count(F.lit(1)).alias("count"), r6(F.avg("value")).alias("avg"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def label_text(labels: str = "labels") -> Column:
    """Label map as JSON with sorted keys, so equal sets group together."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def rollup_series(points: DataFrame, start, end) -> DataFrame:
    """One row per name and full label set over ``[start, end)``."""
    kept = points.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    return kept.groupBy("name", label_text().alias("labels")).agg(
        F.count(F.lit(1)).alias("count"), r6(F.avg("value")).alias("avg"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def top_names(points: DataFrame, since, n: int = 20) -> DataFrame:
    """Most frequent names since a cutoff; ties by name."""
    return (points.filter(F.col("ts") >= F.lit(since)).groupBy("name")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "name").limit(n))


def window_snapshot(points: DataFrame, windows: Sequence[int], as_of, by: Sequence[str] = ("name",)) -> DataFrame:
    """Count, sum, mean, p50, p95, min, max per key over trailing windows.

    Slots of one second: a point counts when its second lies in the last W
    seconds up to and including the second of ``as_of``.
    """
    now = F.floor(F.unix_micros(F.lit(as_of)) / 1_000_000)
    second = F.floor(F.unix_micros("ts") / 1_000_000)
    last = F.date_trunc("second", F.lit(as_of))  # bounds on ts itself, so that they reach the scan
    recent = points.filter((F.col("ts") < last + F.expr("INTERVAL 1 SECOND"))
                           & (F.col("ts") >= last - F.expr(f"INTERVAL {max(windows) - 1} SECONDS")))
    fit = F.filter(F.array(*[F.lit(int(w)) for w in windows]), lambda w: second > now - w)
    spread = recent.select(*by, "value", F.explode(fit).alias("window_s"))
    keys = [*by, "window_s"]
    stats = spread.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), r6(F.sum("value")).alias("sum"), r6(F.avg("value")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    ranks = order_stats(spread, keys, "value", {"p50": position(0.5, -1), "p95": position(0.95, -1)})
    return beside_keys(stats, ranks, keys)


def histogram(points: DataFrame, value: str = "value", bins: int = 50) -> DataFrame:
    """Equal bins between min and max; the top edge falls in the last bin."""
    edge = points.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return (beside(points.filter(F.col(value).isNotNull()).select(value), edge)
            .groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count")))


def latency_heatmap(points: DataFrame, seconds: int = 5, bins: int = 50, top: float | None = None) -> DataFrame:
    """Counts per (time slot, value bin); log-like scale when ``top`` is not given."""
    v = F.col("value")
    if top:
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.lit(float(top))))
    else:
        share = 1.0 - F.exp(-v / (1.0 + v))
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(share * (bins - 1)))).cast("int")
    return points.groupBy(bucket_start("ts", seconds).alias("slot"), at.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))


def recent_stats(points: DataFrame, lookback: int, as_of, by: Sequence[str] = ("name",)) -> DataFrame:
    """Count, mean, min, max and p90 (index ``int(n * 0.9) - 1``) of a look-back."""
    recent = points.filter((F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {int(lookback)} SECONDS"))
                           & (F.col("ts") <= F.lit(as_of)))
    p90 = lambda n: F.greatest(F.floor(n * F.lit(0.9)) - 1, F.lit(0))
    stats = recent.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), r6(F.avg("value")).alias("mean"),
                                    F.min("value").alias("min"), F.max("value").alias("max"))
    return beside_keys(stats, order_stats(recent, by, "value", {"p90": p90}), list(by))


def approx_counts(points: DataFrame, pattern: str) -> DataFrame:
    """Points, names by a glob pattern, and an approximate number of keys."""
    like = "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() else "\\" + c
                         for c in pattern) + "$"
    return points.agg(F.count(F.lit(1)).alias("points"),
                      F.count_if(F.col("name").rlike(like)).alias("matching"),
                      F.approx_count_distinct("name").alias("names"))


# --- billing -------------------------------------------------------------

def usage_totals(usage: DataFrame, since, metrics: Sequence[str] | None = None) -> DataFrame:
    kept = usage.filter(F.col("ts") >= F.lit(since))
    if metrics:
        kept = kept.filter(F.col("metric").isin(*metrics))
    return kept.groupBy("customer_id", "metric").agg(F.sum("quantity").alias("total"))


def invoice_totals(lines: DataFrame, tax_percent: str = "10") -> DataFrame:
    """Subtotal, tax rounded up, total; integer cents throughout."""
    pct = F.lit(tax_percent).cast("decimal(9,4)")
    sub = lines.groupBy("invoice_id").agg(F.sum(F.col("amount_cents") * F.col("quantity")).alias("subtotal_cents"))
    tax = F.ceil(F.col("subtotal_cents").cast("decimal(20,0)") * pct / F.lit(100).cast("decimal(3,0)")).cast("long")
    return sub.select("invoice_id", "subtotal_cents", tax.alias("tax_cents"),
                      (F.col("subtotal_cents") + tax).alias("total_cents"))


# Hours until the next payment attempt.
RETRY_HOURS = (24, 48, 96)


def dunning_list(invoices: DataFrame, attempts: Column, as_of, min_age_hours: int = 24) -> DataFrame:
    """Unpaid invoices old enough, with the time of the next attempt.

    Attempts beyond the last interval keep that interval.
    """
    due = invoices.filter(~F.col("paid") & (F.col("created_at") <= F.lit(as_of) - F.expr(
        f"INTERVAL {int(min_age_hours)} HOURS")))
    hours = F.element_at(F.array(*[F.lit(h) for h in RETRY_HOURS]),
                         F.least(attempts.cast("int") + 1, F.lit(len(RETRY_HOURS))))
    return due.select("invoice_id", "customer_id", "total_cents", attempts.cast("int").alias("attempts"),
                      hours.alias("retry_hours"),
                      (F.lit(as_of) + F.make_interval(hours=hours)).alias("next_retry"))


def run_cost(runs: DataFrame, by: Sequence[str], unit_cost: float = 0.01) -> DataFrame:
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"),
                                 F.round(F.count(F.lit(1)) * F.lit(unit_cost), 2).alias("cost"))


# --- scaling -------------------------------------------------------------

def scaling_summary(actions: DataFrame, hours: int, as_of) -> DataFrame:
    """Target workers, direction counts, action shares and mean score of a window."""
    kept = actions.filter((F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS"))
                          & (F.col("ts") <= F.lit(as_of)))
    n = F.count(F.lit(1))
    up, down = F.count_if(F.col("action") == "scale_up"), F.count_if(F.col("action") == "scale_down")
    steady = F.count_if(F.col("action") == "steady")
    return kept.agg(n.alias("count"), r6(F.avg("to")).alias("avg_to"), F.max("to").alias("max_to"),
                    F.min("to").alias("min_to"), up.alias("up"), down.alias("down"),
                    r6(F.try_divide(up, n)).alias("up_ratio"), r6(F.try_divide(down, n)).alias("down_ratio"),
                    r6(F.try_divide(steady, n)).alias("steady_ratio"), r6(F.avg("score")).alias("mean_score"))


def scaling_drift(actions: DataFrame, last: int = 200, last_change: int = 100,
                  max_std: float = 0.8, max_mean: float = 1.0) -> DataFrame:
    """Spread of the newest scores, and mean relative change between two readings."""
    newest = actions.orderBy(F.desc("ts"), F.desc("event_id")).limit(last)
    scores = newest.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    changed = (actions.orderBy(F.desc("ts"), F.desc("event_id")).limit(last_change)
               .filter((F.col("before") != 0) & (F.col("after") != 0))
               .agg(F.avg((F.col("before") - F.col("after")) / F.greatest(F.lit(1.0), F.abs("before"))).alias("g")))
    return beside(scores, changed).select(
        r6("m").alias("avg_score"), r6("s").alias("stdev"),
        ((F.col("s") > max_std) | (F.abs("m") > max_mean)).alias("drift"), r6("g").alias("avg_improvement"))


def drift_event_stats(events: DataFrame, since, top: int = 10) -> DataFrame:
    """Count, mean and max per feature of drift maps; the highest means first."""
    kept = events.filter(F.col("ts") >= F.lit(since))
    return (kept.select(F.explode("per_feature").alias("feature", "v")).groupBy("feature")
            .agg(F.count(F.lit(1)).alias("count"), r6(F.avg("v")).alias("mean"), F.max("v").alias("max"))
            .orderBy(F.desc("mean"), "feature").limit(top))


# --- tasks and workers ---------------------------------------------------

def queue_depth(tasks: DataFrame, queue: Column) -> DataFrame:
    return tasks.groupBy(queue.alias("queue_key")).agg(
        F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "reserved").alias("in_flight"),
        F.count_if(F.col("status") == "dead").alias("dlq"), F.count(F.lit(1)).alias("total"))


def _window(history: DataFrame, hours: int, as_of) -> DataFrame:
    return history.filter((F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS"))
                          & (F.col("ts") <= F.lit(as_of)))


def throughput(history: DataFrame, hours: int, as_of) -> DataFrame:
    acks = F.count_if(F.col("event") == "ack")
    return _window(history, hours, as_of).agg(
        acks.alias("acks"), F.round(acks / F.lit(hours * 60.0), 2).alias("per_minute"))


def failure_rate(history: DataFrame, hours: int, as_of) -> DataFrame:
    """Failures per ack in percent, and the share of failures among outcomes."""
    fails, acks = F.count_if(F.col("event") == "fail"), F.count_if(F.col("event") == "ack")
    return _window(history, hours, as_of).agg(
        fails.alias("failures"), acks.alias("acks"),
        F.when(acks == 0, F.lit(0.0)).otherwise(F.round(100.0 * fails / F.nullif(acks, F.lit(0)), 2)).alias("failure_pct"),
        F.when(acks + fails == 0, F.lit(0.0)).otherwise(
            F.round(100.0 * fails / F.nullif(acks + fails, F.lit(0)), 2)).alias("failure_share_pct"))


# Every task status.
TASK_STATUSES = ("pending", "reserved", "completed", "failed", "dead", "cancelled")


def status_summary(df: DataFrame, statuses: Sequence[str] = TASK_STATUSES, column: str = "status") -> DataFrame:
    """One row per known status, absent ones with 0; one aggregate, no join."""
    counts = df.agg(*[F.count_if(F.col(column) == s).alias(s) for s in statuses])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("status"), F.col(s).alias("count")) for s in statuses])).alias("x")).select("x.*")


def worker_type_stats(workers: DataFrame, as_of) -> DataFrame:
    running = F.col("status") == "running"
    age = (F.unix_micros(F.lit(as_of)) - F.unix_micros("started_at")) / 1e6
    return workers.groupBy("worker_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(running).alias("running"),
        F.count_if(F.col("status") == "crashed").alias("crashed"),
        F.count_if(F.col("status") == "stopped").alias("stopped"),
        r6(F.avg(F.when(running, age))).alias("mean_uptime_s"))


def backlog_per_worker(depth: DataFrame, running: DataFrame, on: str) -> DataFrame:
    """Backlog over at least one running worker."""
    return depth.join(running, on, "left").select(
        on, "backlog", F.coalesce("running", F.lit(0)).alias("running"),
        r6(F.col("backlog") / F.greatest(F.lit(1), F.coalesce("running", F.lit(0)))).alias("backlog_per_worker"))


def health_rollup(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overall status: the first check that is not ok decides."""
    bad = F.min_by("status", F.when(F.col("status") != "ok", F.col("pos")))
    any_bad = F.count_if(F.col("status") != "ok") > 0
    return checks.groupBy(*by).agg(
        F.when(~any_bad, "ok").when(bad == "warn", "degraded").otherwise("fail").alias("overall"),
        F.count_if(F.col("status") != "ok").alias("not_ok"), F.count(F.lit(1)).alias("components"))


def trace_timeline(log: DataFrame) -> DataFrame:
    """Start and end rows of each node to one row per run and node."""
    at_end = F.col("action") == "node_end"
    return log.groupBy("run_id", "node").agg(
        F.min(F.when(F.col("action") == "node_start", F.col("moment"))).alias("started"),
        F.max(F.when(at_end, F.col("moment"))).alias("ended"),
        F.max(F.when(at_end, F.col("attempts"))).alias("attempts"),
        F.bool_and(F.when(at_end, F.col("success"))).alias("success"))


def run_status(timeline: DataFrame) -> DataFrame:
    """Failed when any ended node failed; nodes that never ended do not count."""
    return timeline.filter(F.col("ended").isNotNull()).groupBy("run_id").agg(
        F.when(F.bool_and("success"), "completed").otherwise("failed").alias("status"),
        F.count(F.lit(1)).alias("nodes"), r6(F.sum(F.col("ended") - F.col("started"))).alias("duration"))


# --- models and drift ----------------------------------------------------

def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """mse, rmse, r2, 95th percentile of the absolute error, row count."""
    errors = df.select((F.col(y) - F.col(yhat)).alias("e"), F.abs(F.col(y) - F.col(yhat)).alias("_abs"),
                       F.col(y).alias("_y"))
    basic = errors.agg(F.avg(F.col("e") * F.col("e")).alias("mse"), F.var_pop("_y").alias("_v"),
                       F.count("e").alias("n"))
    p95 = linear_percentiles(errors, [], "_abs", {"p95_abs_err": 0.95})
    return beside(basic, p95).select(
        r6("mse").alias("mse"), r6(F.sqrt("mse")).alias("rmse"),
        r6(F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")).otherwise(F.lit(0.0))).alias("r2"),
        r6("p95_abs_err").alias("p95_abs_err"), "n")


def _wide_to_long(row: DataFrame, cols: Sequence[str], parts: Sequence[str]) -> DataFrame:
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}_{p}").alias(p) for p in parts]) for c in cols])).alias("x")
    ).select("x.*")


def numeric_drift(ref: DataFrame, new: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Shift of the mean in reference standard deviations, per feature."""
    def side(df, tag):
        wide = df.agg(*[a for c in cols for a in (
            F.avg(F.col(c).cast("double")).alias(f"{c}_m{tag}"), F.stddev_samp(F.col(c).cast("double")).alias(f"{c}_s{tag}"),
            F.count(c).alias(f"{c}_n{tag}"))])
        return _wide_to_long(wide, cols, [f"m{tag}", f"s{tag}", f"n{tag}"])
    both = side(ref, "r").join(side(new, "n"), "feature")
    std = F.when(F.col("sr") > 1e-6, F.col("sr")).otherwise(F.lit(1.0))
    score = F.when((F.col("nr") < 2) | (F.col("nn") < 2), F.lit(0.0)).otherwise(
        F.abs(F.col("mn") - F.col("mr")) / std)
    return both.select("feature", score.alias("score"))


def categorical_drift(ref: DataFrame, new: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Jensen-Shannon divergence (natural log) of category shares, per feature.

    Null is a category of its own.
    """
    def side(df, tag):
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("__NA__")).alias("cat"))
            for c in cols])).alias("x")).select("x.*")
        counts = pairs.groupBy("feature", "cat").agg(F.count(F.lit(1)).alias("c"))
        totals = counts.groupBy("feature").agg(F.sum("c").alias("t"))
        return counts.join(totals, "feature").select("feature", "cat", (F.col("c") / F.col("t")).alias(tag))
    both = side(ref, "a").join(side(new, "b"), ["feature", "cat"], "full_outer").fillna(0.0, ["a", "b"])
    mid = 0.5 * (F.col("a") + F.col("b"))
    part = lambda x: F.sum(F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / mid + 1e-12)).otherwise(F.lit(0.0)))
    return both.groupBy("feature").agg((0.5 * part("a") + 0.5 * part("b")).alias("score"))


def dataset_drift(ref: DataFrame, new: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Drift over shared columns: per feature, mean, flagged ones, sample sizes."""
    kinds = dict(new.dtypes)
    shared = [c for c in new.columns if c in ref.columns]
    number = lambda c: kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    numeric = [c for c in shared if number(c)]
    other = [c for c in shared if c not in numeric]
    parts = ([numeric_drift(ref, new, numeric)] if numeric else []) + (
        [categorical_drift(ref, new, other)] if other else [])
    scores = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # one row per column of the table, so the list stays short
    summary = scores.agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", r6("score")))))).alias("per_feature"),
        r6(F.avg("score")).alias("aggregate"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("score") >= threshold, F.col("feature"))))).alias("flagged"))
    sizes = beside(ref.agg(F.count(F.lit(1)).alias("ref_rows")), new.agg(F.count(F.lit(1)).alias("new_rows")))
    return beside(summary, sizes)


def distribution_drift(ref: DataFrame, cur: DataFrame, value: str, threshold: float = 0.3) -> DataFrame:
    """Mean and spread of the current values against the reference, percentiles too."""
    def side(df, tag):
        basic = df.agg(F.avg(value).alias(f"{tag}_mean"), F.stddev_pop(value).alias(f"{tag}_std"))
        return beside(basic, linear_percentiles(df, [], value, {f"{tag}_p50": 0.5, f"{tag}_p95": 0.95}))
    both = beside(side(ref, "ref"), side(cur, "cur"))
    base = F.col("ref_std") + 1e-8
    mean_drift = F.abs(F.col("cur_mean") - F.col("ref_mean")) / base
    std_drift = F.abs(F.col("cur_std") - F.col("ref_std")) / base
    shift = lambda p: F.abs(F.col(f"cur_{p}") - F.col(f"ref_{p}")) / (F.abs(f"ref_{p}") + 1e-8)
    return both.select(
        r6(F.greatest(mean_drift, std_drift)).alias("drift_score"),
        (F.greatest(mean_drift, std_drift) > threshold).alias("drift_detected"),
        r6(mean_drift).alias("mean_drift"), r6(std_drift).alias("std_drift"),
        r6(shift("p50")).alias("p50_shift"), r6(shift("p95")).alias("p95_shift"),
        *[r6(f"{s}_{m}").alias(f"{s}_{m}") for s in ("ref", "cur") for m in ("mean", "std", "p50", "p95")])


def array_dimension_stats(df: DataFrame, array: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, min and max of each array position."""
    long = df.select(*by, F.posexplode(array).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    return long.groupBy(*by, "dim").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"),
                                        r6(F.min("v")).alias("min"), r6(F.max("v")).alias("max"))


def episode_summary(steps: DataFrame, requested: int | None = None) -> DataFrame:
    """Episode rewards summed, then their count, mean, spread and percentiles.

    Positions are ``int(p * n)``.
    """
    episodes = steps.groupBy("episode").agg(
        F.round(F.sum("reward"), 6).alias("reward"), F.count(F.lit(1)).alias("length"),
        F.bool_or("failed").alias("failed"))
    done = episodes.filter(~F.col("failed"))
    stats = done.agg(
        F.count(F.lit(1)).alias("completed"), r6(F.avg("reward")).alias("reward_mean"),
        r6(F.stddev_pop("reward")).alias("reward_std"), F.min("reward").alias("reward_min"),
        F.max("reward").alias("reward_max"), r6(F.avg("length")).alias("mean_episode_length"))
    asked = episodes.agg(F.count(F.lit(1)).alias("requested") if requested is None
                         else F.lit(requested).cast("long").alias("requested"))
    ranks = order_stats(done, [], "reward", {"reward_p50": position(0.5), "reward_p95": position(0.95)})
    return (beside(beside(asked, stats), ranks)
            .withColumn("failed", F.col("requested") - F.col("completed")))


def run_step_summary(steps: DataFrame) -> DataFrame:
    """Last cumulative counters and mean backlog of each run."""
    return steps.groupBy("run_id").agg(
        F.max_by("processed_cumulative", "t").alias("total_processed"),
        F.max_by("failed_cumulative", "t").alias("total_failed"), r6(F.avg("backlog")).alias("avg_backlog"))


def timing_summary(df: DataFrame, by: str, value: str, rows_per_call: Column | None = None) -> DataFrame:
    """Mean, deviation, interpolated percentiles and rate of timings per group."""
    stats = df.groupBy(by).agg(F.avg(value).alias("m"), r6(F.stddev_pop(value)).alias("std"),
                               F.count(value).alias("n"))
    ranks = linear_percentiles(df, [by], value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    out = beside_keys(stats, ranks, [by])
    size = rows_per_call if rows_per_call is not None else F.lit(1.0)
    return out.select(by, r6("m").alias("mean"), "std", *[r6(p).alias(p) for p in ("p50", "p95", "p99")],
                      r6(F.try_divide(size, F.col("m"))).alias("rate"), "n")


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with mean and deviation (1 where it is tiny) of each column."""
    parts = []
    for c in cols:
        s = F.stddev_samp(c)
        parts += [F.avg(c).alias(f"{c}_mean"), F.when(s > 1e-6, s).otherwise(F.lit(1.0)).alias(f"{c}_std")]
    return df.agg(*parts)


def blend_scaler(old: DataFrame, new: DataFrame, keep: float = 0.9) -> DataFrame:
    """Old statistics moved towards those of a new batch."""
    names = old.columns
    both = beside(old.select(*[F.col(c).alias(f"_o_{c}") for c in names]), new)
    return both.select(*[(keep * F.col(f"_o_{c}") + (1 - keep) * F.col(c)).alias(c) for c in names])


def zscore_columns(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns centred and scaled; nulls become 0."""
    both = beside(df, scaler)
    done = {c: F.coalesce((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"), F.lit(0.0)) for c in cols}
    return both.withColumns(done).drop(*[f"{c}_{p}" for c in cols for p in ("mean", "std")])


def folder_hash(manifest: DataFrame, folder: Column) -> DataFrame:
    """One digest per folder over its sorted (path, sha256) pairs.

    A tree of digests, so that a folder with very many files is never one list:
    files are grouped by the first six hex digits of their path's hash, groups
    by the first three, and those by folder. Each level digests its sorted
    members; a list holds 4096 entries, or one 16-millionth of the files.
    """
    digest = lambda line: F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("h")
    level = manifest.select(folder.alias("folder"), F.substring(F.sha2("path", 256), 1, 6).alias("part"),
                            F.concat_ws(":", "path", "sha256").alias("line"), F.lit(1).cast("long").alias("n"))
    for digits in (6, 3, 0):
        level = (level.groupBy("folder", F.substring("part", 1, digits).alias("part"))
                 .agg(digest(F.col("line")), F.sum("n").alias("n"))
                 .select("folder", "part", F.concat_ws(":", "part", "h").alias("line"), "h", "n"))
    return level.select("folder", F.col("h").alias("digest"), F.col("n").alias("files"))
