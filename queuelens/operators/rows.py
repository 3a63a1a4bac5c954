"""Projections, filters and row rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.functions.columns import parse_instant, queue_key
from queuelens.operators.orderstats import order_stats
from queuelens.operators.slices import global_position


def basic_clean(df: DataFrame, time_col: str = "timestamp", as_of: Column | None = None) -> DataFrame:
    """Telemetry with a proper ``ts`` and typed, filled columns.

    Epoch seconds or text become an instant (bad text null, no column: as_of);
    ``success`` and ``duration_ms`` become integers with bad values 0; absent
    ``priority``, ``queue_length`` and ``consumer_count`` get 0, 0 and 1.
    """
    kinds = dict(df.dtypes)
    if time_col not in kinds:
        df = df.withColumn("ts", as_of if as_of is not None else F.current_timestamp())
    elif kinds[time_col] == "string":
        df = df.withColumn("ts", F.try_to_timestamp(F.col(time_col)))
    elif kinds[time_col].startswith("timestamp"):
        df = df.withColumn("ts", F.col(time_col).cast("timestamp"))
    else:
        df = df.withColumn("ts", F.timestamp_seconds(F.col(time_col)))

    def whole(c: str) -> Column:
        return F.coalesce(F.col(c).try_cast("double").try_cast("int"), F.lit(0))

    if "success" in kinds:
        flag = F.lower(F.col("success").cast("string"))
        df = df.withColumn("success", F.when(flag == "true", 1).when(flag == "false", 0).otherwise(whole("success")))
    if "duration_ms" in kinds:
        df = df.withColumn("duration_ms", whole("duration_ms"))
    for c, default in (("priority", 0), ("queue_length", 0), ("consumer_count", 1)):
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(default)) if c in kinds else F.lit(default))
    return df


def label_filter(df: DataFrame, labels: dict[str, str], column: str = "labels") -> DataFrame:
    """Rows whose label map holds every given pair."""
    for k, v in labels.items():
        df = df.filter(F.col(column)[k] == v)
    return df


def time_range(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Rows from start to end, both kept; either side may be open."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end))
    return df


MESSAGE = T.StructType([T.StructField(n, T.StringType()) for n in (
    "id", "type", "task_type", "payload", "data", "created_at")] + [T.StructField("retries", T.IntegerType())])


def normalize_tasks(df: DataFrame, raw: str) -> DataFrame:
    """Task messages of the old and the new shape to one set of columns."""
    m = F.from_json(raw, MESSAGE)
    return df.withColumn("_m", m).select(
        *[c for c in df.columns if c != raw], F.col("_m.id").alias("id"),
        F.coalesce("_m.type", "_m.task_type", F.lit("generic")).alias("type"),
        F.coalesce("_m.payload", "_m.data").alias("payload"),
        F.coalesce("_m.retries", F.lit(0)).alias("retries"), parse_instant("_m.created_at").alias("created_at"))


def validate_route(df: DataFrame, rules: dict[str, Column], topic: str, payload: Column, key: str, as_of) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and DLQ entries.

    A rule is a condition that must hold; null counts as failed. A row that
    breaks its schema is never retried.
    """
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
    marked = df.withColumn("_broken", broken)
    valid = marked.filter(F.size("_broken") == 0).drop("_broken")
    dead = marked.filter(F.size("_broken") > 0).select(
        F.col(key).alias("original_id"), F.lit(topic).alias("source"), payload.alias("payload"),
        F.concat_ws(",", "_broken").alias("error"), F.lit(as_of).alias("ts"), F.lit(False).alias("retry"))
    return valid, dead


def check_types(cfg: DataFrame, schema: DataFrame) -> DataFrame:
    """Whether each value parses as its declared type; unknown keys are valid."""
    v = F.col("value")
    ok = (F.when(F.col("expected_type") == "int", v.rlike(r"^\s*[+-]?\d+\s*$"))
          .when(F.col("expected_type") == "float", v.try_cast("double").isNotNull())
          .when(F.col("expected_type") == "bool", F.lower(v).isin("true", "false", "1", "0"))
          .otherwise(F.lit(True)))
    return cfg.join(schema, "key", "left").withColumn("valid", F.coalesce(ok, F.lit(False)))


def nan_check(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    c = F.col(column)
    odd = F.count_if(F.isnan(c)) + F.count_if(F.abs(c) == float("inf"))
    mean = F.avg(c)
    return df.agg(F.count_if(F.isnan(c)).alias("nan_count"), F.count_if(F.abs(c) == float("inf")).alias("inf_count"),
                  F.when(odd > 0, "FAILED").otherwise("PASSED").alias("stability"),
                  (~F.isnan(mean) & (mean > high)).alias("above_max"), (~F.isnan(mean) & (mean < low)).alias("below_min"))


def category_codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """Value and code in order of first appearance; null counts as ''."""
    firsts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(
        F.min(order).alias("first_seen"))
    return global_position(firsts, "first_seen", "code").withColumn("code", F.col("code").cast("int") - 1)


def encode_categoricals(df: DataFrame, columns: Sequence[str], order: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Columns replaced by codes, and the value-to-code table of each.

    The join side is left to the optimizer: it is broadcast when its measured
    size is small and shuffled otherwise.
    """
    maps = {}
    for c in columns:
        maps[c] = category_codes(df, c, order).select("value", "code")
        side = maps[c].withColumnsRenamed({"value": "_value", "code": "_code"})
        df = (df.join(side, F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col("_value"), "left")
              .drop("_value", c).withColumnRenamed("_code", c))
    return df, maps


def feature_matrix(df: DataFrame, features: Sequence[str] | None, label: str, keep: Sequence[str] = ()) -> DataFrame:
    """Chosen (by default all numeric) columns as floats, null 0; label as long."""
    if features is None:
        numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
        features = [c for c, t in df.dtypes if t in numeric and c != label and c not in keep]
    return df.select(*keep, *[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")).alias(c) for c in features],
                     F.coalesce(F.col(label).cast("long"), F.lit(0)).alias("label"))


def priority_override(tasks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Priority plus the override of the type, else of tenant and type.

    ``overrides`` has ``scope`` (a task type or ``tenant:type``) and ``delta``.
    """
    scoped = F.concat_ws(":", F.coalesce("tenant", F.lit("global")), "task_type")
    by_type = overrides.select(F.col("scope").alias("task_type"), F.col("delta").alias("_a"))
    by_scope = overrides.select(F.col("scope").alias("_scope"), F.col("delta").alias("_b"))
    joined = (tasks.withColumn("_scope", scoped).join(by_type, "task_type", "left").join(by_scope, "_scope", "left"))
    return joined.withColumn("priority", F.greatest(F.lit(1), F.least(F.lit(1000), F.col("priority") + F.coalesce(
        "_a", "_b", F.lit(0))))).drop("_a", "_b", "_scope")


def retry_decision(attempts: Column, max_retries: int = 5, backoff: float = 30.0, factor: float = 2.0) -> dict[str, Column]:
    """Queue rule after one more failure: retry after a delay, or dead."""
    tried = attempts + 1
    again = tried < max_retries
    return {"attempts_after": tried.cast("int"), "decision": F.when(again, "retry").otherwise("dead"),
            "delay_s": F.when(again, F.floor(F.lit(backoff) * F.pow(F.lit(factor), tried - 1)).cast("int"))}


def worker_retry_decision(retries: Column, drop: Column, retriable: Column, max_retries: int = 5) -> dict[str, Column]:
    """Worker rule: drop flag, too many retries or non-retriable go to the DLQ."""
    tried = retries + 1
    dlq = drop | (tried > max_retries) | ~retriable
    return {"worker_decision": F.when(drop, "dlq_drop").when(dlq, "dlq").otherwise("retry"),
            "worker_delay_s": F.when(~dlq, F.pow(F.lit(2.0), F.least(F.lit(6), tried)).cast("int"))}


def backoff_schedule(df: DataFrame, attempts: int | Column, base: float = 1.0, factor: float = 2.0, cap: float = 60.0,
                     jitter: float = 0.0, seed_col: str | None = None) -> DataFrame:
    """One row per attempt with its delay; jitter, when asked for, is by hash."""
    last = F.lit(attempts) if isinstance(attempts, int) else attempts
    rows = df.withColumn("attempt", F.explode(F.sequence(F.lit(0), last)))
    delay = F.least(F.lit(base) * F.pow(F.lit(factor), F.col("attempt")), F.lit(cap))
    if jitter:
        share = F.pmod(F.xxhash64(seed_col, "attempt"), F.lit(1_000_000)) / 1e6
        delay = delay * (1 + F.lit(jitter) * (2 * share - 1))
    return rows.withColumn("delay_s", delay)


def policy_stats(points: DataFrame, policies: DataFrame, as_of) -> DataFrame:
    """Count and p90 of each policy's metric over twice its cooldown.

    Points meet each distinct (metric, span) once, however many policies share
    it; a policy without points gets p90 0.
    """
    spans = policies.select("metric", (F.col("cooldown_s") * 2).alias("_span")).distinct()
    longest = spans.agg(F.max("_span")).first()[0] or 0  # one number, so that the scan is bounded
    age = (F.unix_micros(F.lit(as_of)) - F.unix_micros("ts")) / 1e6
    recent = points.filter((F.col("ts") <= F.lit(as_of)) & (F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {int(longest)} SECONDS")))
    hit = (recent.join(spans, points["name"] == spans["metric"])
           .filter(age <= F.col("_span")).select("metric", "_span", "value"))
    p90 = order_stats(hit, ["metric", "_span"], "value", {"p90": lambda n: F.greatest(F.floor(n * F.lit(0.9)) - 1, F.lit(0))})
    joined = policies.withColumn("_span", F.col("cooldown_s") * 2).join(p90, ["metric", "_span"], "left").fillna(0.0, ["p90"])
    return joined.select(*policies.columns, "p90")


def desired_replicas(stats: DataFrame) -> DataFrame:
    """Wanted replicas of each policy and what happens to it.

    Needs p90, up, down, min_replicas, max_replicas, hysteresis, current, mode,
    ml, rl, in_cooldown. Unset (or zero) current counts as the minimum.
    """
    cur = F.coalesce(F.nullif("current", F.lit(0)), F.col("min_replicas"))
    over = F.col("p90") / (F.col("up") + 1e-9)
    under = F.col("p90") / (F.col("down") + 1e-9)
    grow = F.greatest(F.lit(1), F.ceil((F.col("max_replicas") - F.col("min_replicas")) * F.least(over - 1.0, F.lit(2.0))
                                      * (1 + F.col("hysteresis"))))
    shrink = F.greatest(F.lit(1), F.ceil(cur * (1 - under) * (1 + F.col("hysteresis"))))
    rule = (F.when(F.col("up").isNotNull() & (F.col("p90") >= F.col("up")), F.least("max_replicas", cur + grow))
            .when(F.col("down").isNotNull() & (F.col("p90") <= F.col("down")), F.greatest("min_replicas", cur - shrink)))
    found = stats.withColumn("cur", cur.cast("long")).withColumn("rule", rule.cast("long"))
    options = F.array_sort(F.array_compact(F.array(F.col("rule"), F.col("ml").cast("long"), F.col("rl").cast("long"))))
    middle = F.element_at(F.col("_options"), (F.floor(F.size("_options") / 2) + 1).cast("int"))
    some = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit(0)).cast("long") for c in cs], F.col("cur"))
    hybrid = (F.when(F.size("_options") == 0, F.col("cur")).when(F.col("rule") > F.col("cur"), F.array_max("_options"))
              .when(F.col("rule") < F.col("cur"), F.array_min("_options")).otherwise(middle))
    pick = (F.when(F.col("mode") == "rule", some("rule")).when(F.col("mode") == "ml", some("ml", "rl")).otherwise(hybrid))
    bounded = F.greatest("min_replicas", F.least("max_replicas", pick)).cast("long")
    out = found.withColumn("_options", options).withColumn("desired", bounded).withColumn(
        "delta", F.col("desired") - F.col("cur"))
    return out.withColumn("outcome", F.when(F.col("in_cooldown"), "skipped").when(F.col("delta") == 0, "no_change")
                          .otherwise("scale")).drop("_options")


def coupon_valid(coupons: DataFrame, redemptions: DataFrame, as_of) -> DataFrame:
    used = redemptions.groupBy("coupon_id").agg(F.count(F.lit(1)).alias("used"))
    joined = coupons.join(used, "coupon_id", "left").fillna(0, ["used"])
    full = (F.col("max_redemptions") > 0) & (F.col("used") >= F.col("max_redemptions"))
    return joined.withColumn("state", F.when(F.col("expires_at") < F.lit(as_of), "expired").when(full, "used_up")
                             .otherwise("valid"))


# Stable settings, limits above (or below) which a run is unsafe, and score penalties.
STABLE = {"gamma": 0.99, "lam": 0.95, "steps_per_epoch": 2048}
UNSAFE = {"gamma": 0.995, "lam": 0.97, "lr": 1e-3, "steps_per_epoch": 4096, "value_coef": 0.25}
USUAL_LR = (3e-4, 1e-4)


def config_stability(runs: DataFrame) -> DataFrame:
    """Score from 100 by fixed penalties, stable flag and issue list.

    A run without any setting has no configuration: it loses 20 points and stays stable.
    """
    c = F.col
    settings = ("gamma", "lam", "lr", "steps_per_epoch", "use_clipped_value_loss", "value_coef", "normalize_advantages", "normalize_observations", "normalize_rewards", "max_grad_norm")
    given = F.coalesce(*[c(x).cast("string") for x in settings]).isNotNull()
    clipped = F.coalesce(c("use_clipped_value_loss"), F.lit(True))
    checks = [  # (name, condition, penalty, makes unstable)
        ("gamma_high", c("gamma") >= UNSAFE["gamma"], 40, True),
        ("gamma_off", (c("gamma") < UNSAFE["gamma"]) & (F.abs(c("gamma") - STABLE["gamma"]) > 0.01), 10, False),
        ("lam_high", c("lam") >= UNSAFE["lam"], 40, True),
        ("lam_off", (c("lam") < UNSAFE["lam"]) & (F.abs(c("lam") - STABLE["lam"]) > 0.01), 10, False),
        ("lr_high", c("lr") >= UNSAFE["lr"], 40, True),
        ("lr_off", (c("lr") < UNSAFE["lr"]) & ~c("lr").isin(*USUAL_LR), 10, False),
        ("steps_high", c("steps_per_epoch") >= UNSAFE["steps_per_epoch"], 30, True),
        ("steps_off", (c("steps_per_epoch") < UNSAFE["steps_per_epoch"]) & (c("steps_per_epoch") != STABLE["steps_per_epoch"]), 5, False),
        ("value_coef_low", ~clipped & (c("value_coef") <= UNSAFE["value_coef"]), 50, True),
        ("value_loss_not_clipped", ~F.coalesce(c("use_clipped_value_loss"), F.lit(False)), 50, True),
        ("advantages_raw", ~F.coalesce(c("normalize_advantages"), F.lit(True)), 10, False),
        ("observations_raw", ~F.coalesce(c("normalize_observations"), F.lit(True)), 40, True),
        ("rewards_raw", ~F.coalesce(c("normalize_rewards"), F.lit(True)), 10, False),
        ("grad_norm", c("max_grad_norm").isNull() | (c("max_grad_norm") > 1.0), 10, False),
    ]
    hit = [(n, given & F.coalesce(cond, F.lit(False)), p, bad) for n, cond, p, bad in checks] + [("config_missing", ~given, 20, False)]
    score = sum((-F.when(cond, float(p)).otherwise(0.0) for _, cond, p, _ in hit), F.lit(100.0))
    unstable = F.lit(False)
    for _, cond, _, bad in hit:
        unstable = unstable | cond if bad else unstable
    issues = F.concat_ws(",", F.array_compact(F.array(*[F.when(cond, n) for n, cond, _, _ in hit])))
    return runs.withColumns({"stability_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)),
                             "stable": ~unstable, "issues": issues})


def metric_stability(metrics: DataFrame) -> DataFrame:
    """Issues in logged training metrics: NaN, large values, large divergence."""
    c = F.col
    issues = F.array_compact(F.array(
        F.when(F.isnan("value_mean") | F.isnan("kl_div"), "nan"),
        F.when(~F.isnan("value_mean") & (F.abs("value_mean") > 100), "value_explosion"),
        F.when(~F.isnan("kl_div") & (c("kl_div") > 0.1), "kl_divergence")))
    return metrics.withColumns({"metric_issues": F.concat_ws(",", issues), "metrics_stable": F.size(issues) == 0})


def promotion_decision(runs: DataFrame, baseline: DataFrame, on: str, min_samples: int = 50,
                       improve_abs: float | None = None, improve_rel: float = 0.01, canary_limit: float = 5.0,
                       regression_tolerance: float = 0.2) -> DataFrame:
    """Promotion verdict with its reason; canary gate and regression flag beside it."""
    joined = runs.join(baseline.select(on, F.col("rmse").alias("base_rmse"), F.lit(True).alias("_has_base")), on, "left")
    new, base = F.col("rmse"), F.col("base_rmse")
    gain = (base - new) / F.nullif(base, F.lit(0.0))
    reason = (F.when(new.isNull(), "metric_missing")
              .when(F.coalesce("n_samples", F.lit(0)) < min_samples, "insufficient_samples"))
    if improve_abs is not None:
        reason = reason.when(new <= improve_abs, "absolute_threshold")
    reason = reason.when(F.col("_has_base") & base.isNull(), "baseline_missing")
    reason = (reason.when(base > 0, F.when(gain >= improve_rel, "relative_improvement").otherwise("insufficient_improvement"))
              .otherwise("no_promotion_condition_met"))
    return joined.withColumns({
        "reason": reason, "promote": reason.isin("absolute_threshold", "relative_improvement"),
        "canary_ok": F.coalesce(new <= canary_limit, F.lit(False)),
        "regressed": F.coalesce((base > 0) & ((new - base) / F.nullif(base, F.lit(0.0)) > regression_tolerance), F.lit(False))}).drop("_has_base")


def hint_dedup(policy_hints: DataFrame, rates: DataFrame) -> DataFrame:
    """Largest suggestion per queue of two sources; the first source wins ties.

    Built as one aggregate over an ordering key, so a busy queue combines
    map-side.
    """
    forecast = rates.filter(F.col("rate") > 5.0).select(
        "queue", F.greatest(F.lit(1), F.ceil(F.col("rate") / 10.0)).cast("int").alias("suggested"),
        F.lit("predictor").alias("source"), F.lit(1).alias("_rank"))
    both = policy_hints.select("queue", F.col("suggested").cast("int"), F.lit("rl_agent").alias("source"),
                               F.lit(0).alias("_rank")).unionByName(forecast)
    best = F.max(F.struct("suggested", (-F.col("_rank")).alias("r"), "source"))
    return both.groupBy("queue").agg(best.alias("b")).select("queue", F.col("b.suggested"), F.col("b.source"))


def replay_to_xy(df: DataFrame, fn: Callable | None = None, schema: str | None = None) -> DataFrame:
    """Transitions to ``x = state + [action]`` and ``y = reward``.

    ``fn`` (an iterator of pandas frames to the same) may replace the rule.
    """
    if fn is not None:
        return df.mapInPandas(fn, schema)
    x = F.concat(F.transform("state", lambda v: v.cast("float")), F.array(F.col("action").cast("float")))
    return df.select("id", x.alias("x"), F.col("reward").cast("float").alias("y"))


def route_by_condition(df: DataFrame, rules: Sequence[tuple[str, str]], default: str = "default") -> DataFrame:
    """First route whose SQL condition holds; null counts as false.

    Conditions come from trusted configuration. Use ``try_`` functions in them
    where a row could make an expression fail.
    """
    route = None
    for name, text in rules:
        hit = F.coalesce(F.expr(text), F.lit(False)) if text.strip() else F.lit(False)
        route = F.when(hit, name) if route is None else route.when(hit, name)
    return df.withColumn("route", route.otherwise(default))


def activate_version(models: DataFrame, chosen: DataFrame, force: bool = False) -> DataFrame:
    """Chosen versions become active, others of their type inactive.

    A version with a score below 70 or marked unstable is refused unless forced.
    """
    pick = chosen.select("version_id").distinct().withColumn("_pick", F.lit(True))
    marked = models.join(pick, "version_id", "left").fillna(False, ["_pick"])
    allowed = F.lit(True) if force else (F.coalesce(F.col("score"), F.lit(100.0)) >= 70.0) & F.coalesce(
        F.col("stable"), F.lit(True))
    marked = marked.withColumn("_new", F.col("_pick") & allowed)
    touched = marked.groupBy("model_type").agg(F.bool_or("_new").alias("_touched"))
    out = marked.join(touched, "model_type")
    return out.withColumns({
        "active": F.when(F.col("_touched"), F.col("_new")).otherwise(F.col("active")),
        "blocked": F.col("_pick") & ~F.col("_new")}).drop("_pick", "_new", "_touched")


def overdue_runs(exps: DataFrame, as_of, grace: int = 30) -> DataFrame:
    """Running experiments past their end plus a grace become completed."""
    age = (F.unix_micros(F.lit(as_of)) - F.unix_micros("started_at")) / 1e6
    late = (F.col("status") == "running") & (age > F.col("duration_seconds") + grace)
    return exps.withColumns({"status": F.when(late, "completed").otherwise(F.col("status")),
                             "stopped_at": F.when(late, F.lit(as_of))})


def restart_decision(workers: DataFrame, policy: Column, max_restarts: int = 10, base: float = 1.0, cap: float = 60.0) -> DataFrame:
    """What to do with stopped and crashed workers, and after what delay."""
    down = F.col("status").isin("crashed", "stopped")
    allowed = F.when(F.col("exit_code") != 0, policy.isin("always", "on-failure")).otherwise(policy == "always")
    verdict = (F.when(~down, "none").when(~allowed, "not_allowed").when(F.col("restarts") >= max_restarts, "exhausted")
               .otherwise("restart"))
    delay = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("restarts") - 1)))
    return workers.withColumns({"decision": verdict, "backoff_s": F.when(verdict == "restart", delay)})
