"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def queue_key(tenant: str, task_type: str, prefix: str = "queue") -> Column:
    """Prefix, tenant if there is one, and task type."""
    return F.concat_ws(":", F.lit(prefix), F.col(tenant), F.col(task_type))


def parse_instant(text: str | Column) -> Column:
    """Epoch seconds (with or without a fraction) or ISO text to an instant; else null."""
    t = F.trim(col(text))
    seconds = t.try_cast("double")
    return F.when(seconds.isNotNull() & t.rlike(r"^[0-9.+-]+$") & ~t.rlike(r"^\d{4}-"),
                  F.timestamp_micros(F.round(seconds * 1_000_000).cast("long"))).otherwise(
        F.try_to_timestamp(t))


# Seconds per duration unit; any other unit counts as 1.
UNIT_SECONDS = {
    "s": 1, "sec": 1, "secs": 1, "seconds": 1,
    "m": 60, "min": 60, "mins": 60, "minute": 60,
    "h": 3600, "hr": 3600, "hour": 3600,
    "d": 86400, "day": 86400,
    "w": 604800, "week": 604800,
}


def parse_duration(text: str | Column) -> Column:
    """Text such as ``1d 4h 15m`` or ``1.5h`` to seconds; empty or null is 0."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    pattern = F.lit(r"(\d+\.?\d*)\s*([a-z]+)")
    numbers = F.regexp_extract_all(t, pattern, F.lit(1))
    units = F.regexp_extract_all(t, pattern, F.lit(2))
    table = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    parts = F.zip_with(numbers, units, lambda n, u: n.cast("double") * F.coalesce(F.try_element_at(table, u), F.lit(1)))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def mask(text: str | Column, keep: int = 4) -> Column:
    """First characters kept and the rest starred; short values are all stars."""
    t = col(text)
    n = F.length(t)
    return F.when(n <= keep + 2, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(t, 1, keep), F.repeat(F.lit("*"), n - keep)))


def to_cents(amount: str | Column) -> Column:
    """Currency amount to whole cents."""
    return F.round(col(amount) * 100).cast("long")


def money_text(cents: str | Column, currency: str = "USD") -> Column:
    c = col(cents)
    sign = F.when(c < 0, "-").otherwise("")
    return F.format_string(f"%s%d.%02d {currency}", sign, F.floor(F.abs(c) / 100), F.abs(c) % 100)


def text_match(cols: Sequence[str], wanted: str) -> Column:
    """Case-free substring in any column; an empty text matches all."""
    if not wanted:
        return F.lit(True)
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted.lower())), F.lit(False))
    return hit


def scale_hint(score: str | Column) -> Column:
    s = col(score)
    return F.when(s >= 0.8, "scale_up").when(s <= 0.3, "scale_down").otherwise("steady")


# Thresholds and weights of the rule score.
BACKLOG_UP, BACKLOG_DOWN = 1000, 50
LATENCY_UP, LATENCY_DOWN = 1.5, 0.7
CPU_UP, CPU_DOWN = 0.8, 0.35


def rule_score(backlog="backlog", latency="latency", cpu="cpu") -> Column:
    """Sum of threshold signals of three gauges, clamped to [-2, 2]."""
    def signal(c, up, gain, down, loss):
        return F.when(col(c) >= up, gain).when(col(c) <= down, -loss).otherwise(0.0)
    total = (signal(backlog, BACKLOG_UP, 1.2, BACKLOG_DOWN, 1.0) + signal(latency, LATENCY_UP, 1.0, LATENCY_DOWN, 0.8)
             + signal(cpu, CPU_UP, 0.6, CPU_DOWN, 0.4))
    return clamp(total, -2.0, 2.0)


def ml_hint(raw: str | Column, queue_length: str | Column) -> Column:
    return F.tanh(col(raw) / F.greatest(F.lit(1.0), col(queue_length) + 1.0) * 3.0)


def fuse_scores(rule: str | Column, ml: str | Column, rl: str | Column) -> Column:
    """Weighted mean of the scores present, weights renormalised, clamped."""
    pairs = [(col(rule), 0.5), (col(ml), 0.3), (col(rl), 0.2)]
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in pairs), F.lit(0.0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in pairs), F.lit(0.0))
    return F.when(weight > 0, clamp(total / F.nullif(weight, F.lit(0.0)), -2.0, 2.0)).otherwise(F.lit(0.0))


def score_action(score: str | Column, band: float = 0.15) -> Column:
    s = col(score)
    return F.when(s > band, "scale_up").when(s < -band, "scale_down").otherwise("steady")


# Expected scale of each of the twelve observation dimensions.
OBSERVATION_SCALES = (5000.0, 100.0, 500.0, 1000.0, 1.0, 100.0, 1.0, 1.0, 1500.0, 1.0, 1.0, 200.0)


def normalize_obs(obs: str | Column, scales: Sequence[float] = OBSERVATION_SCALES) -> Column:
    return F.zip_with(col(obs), F.array(*[F.lit(s) for s in scales]),
                      lambda v, s: clamp(v.cast("double") / (s + 1e-8), -5.0, 5.0))


# Observation columns, their accepted names, and defaults.
OBSERVATION_FIELDS = (
    ("queue_length", ("queue_length", "queue"), 0.0),
    ("consumer_count", ("consumer_count", "worker_count"), 0.0),
    ("avg_latency_ms", ("avg_latency_ms", "avg_lat_ms"), 0.0),
    ("p95_latency_ms", ("p95_latency_ms", "p95_lat_ms"), 0.0),
    ("success_rate", ("success_rate",), 1.0),
    ("arrival_rate", ("arrival_rate", "arrival"), 0.0),
    ("cpu", ("cpu",), 0.0),
    ("mem", ("mem", "memory_utilization"), 0.0),
)


def build_observation(metrics: str | Column) -> list[Column]:
    """Eight doubles from a text map, by the first name present."""
    m = col(metrics)
    return [F.coalesce(*[F.try_element_at(m, F.lit(n)).try_cast("double") for n in names], F.lit(default)).alias(field)
            for field, names, default in OBSERVATION_FIELDS]


def heuristic_action(queue="queue_len", consumers="consumers", latency="avg_lat", max_delta: int = 10,
                     throttle_limit: float = 1.0, sla_ms: float = 500.0, min_consumers: int = 1,
                     max_consumers: int = 200) -> dict[str, Column]:
    """Consumer change, throttle and priority from queue, consumers and latency."""
    q, c, lat = col(queue), col(consumers), col(latency)
    up = F.least(F.lit(max_delta), F.greatest(F.lit(1), (F.ceil(q / F.greatest(F.lit(1), c)) - 1).cast("int")))
    delta = (F.when((lat > sla_ms) & (q > c * 2), up)
             .when(q < F.greatest(F.lit(5), F.floor(c / 2)), F.lit(-1)).otherwise(F.lit(0)))
    wanted = F.greatest(F.lit(-max_delta), F.least(F.lit(max_delta), delta))
    at = c.cast("int")
    bounded = (F.when(at + wanted < min_consumers, F.lit(min_consumers) - at)
               .when(at + wanted > max_consumers, F.lit(max_consumers) - at).otherwise(wanted))
    throttle = clamp(lat / max(1.0, sla_ms) - 1.0, 0.0, throttle_limit)
    return {"delta": bounded.cast("int"), "throttle": throttle, "priority": (lat > sla_ms).cast("int")}


# Targets and weights of the service score.
SLO = {"p95_ms": 2000.0, "success": 0.995, "max_queue": 200000.0, "latency_w": 2.0, "cost_w": 1.0,
       "availability_w": 3.0, "efficiency_w": 0.5, "stability_w": 0.3, "bonus": 2.0}


def slo_score(p95="p95", success="success_rate", queue="queue", workers="workers", healthy="healthy",
              cost="cost", delta="delta", cfg: dict = SLO) -> dict[str, Column]:
    """Bounded service score and two flags."""
    p, s, q, w = col(p95), col(success), col(queue), col(workers)
    latency = -F.tanh((p - cfg["p95_ms"]) / (cfg["p95_ms"] + 1e-8)) * cfg["latency_w"]
    avail = -F.tanh((cfg["success"] - s) / (cfg["success"] + 1e-8) * 3.0) * cfg["availability_w"]
    done = w * (col(healthy) / F.greatest(F.lit(1.0), w)) * s
    price = F.when(done > 0, -F.tanh(col(cost) / F.nullif(done, F.lit(0.0)) / 0.001 - 1.0) * cfg["cost_w"]).otherwise(
        F.lit(-cfg["cost_w"]))
    share = q / (cfg["max_queue"] + 1e-8)
    queue_part = -F.tanh((share - 0.3) * 3.0)
    use = -F.tanh(F.abs(q / F.greatest(F.lit(1.0), w * 10.0) - 0.65) * 2.0) * cfg["efficiency_w"]
    calm = -F.tanh(F.abs(col(delta)) / 10.0) * cfg["stability_w"]
    p_ok, s_ok = p <= cfg["p95_ms"], s >= cfg["success"]
    bonus = F.when(p_ok & s_ok & (share < 0.5), cfg["bonus"]).otherwise(0.0)
    return {"score": clamp(latency + avail + price + queue_part + use + calm + bonus, -20.0, 20.0),
            "p95_met": p_ok, "success_met": s_ok}
