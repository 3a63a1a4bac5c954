"""Comparison of two arms of an experiment."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.operators.aggregates import r6
from queuelens.operators.orderstats import value_grid
from queuelens.operators.slices import passed, prefix_frame
from queuelens.operators.scalars import beside


def arm_moments(df: DataFrame, arm: str, value: str) -> DataFrame:
    """One row: size, mean and variance of arms ``a`` (baseline) and ``b``."""
    pick = lambda a: F.when(F.col(arm) == a, F.col(value))
    return df.agg(*[c for a in ("a", "b") for c in (
        F.count(pick(a)).alias(f"n_{a}"), F.avg(pick(a)).alias(f"mean_{a}"), F.var_pop(pick(a)).alias(f"var_{a}"))])


def rank_sum(df: DataFrame, arm: str, value: str) -> DataFrame:
    """One row: U of arm ``b`` and the tie term, with mean ranks for ties.

    Values are counted per arm first; distinct values are numbered by running
    sums over about equally full parts, which a sketch of the values gives, so
    no task sees all of them however narrow their range.
    """
    part = lambda: passed(F.array(*[F.lit(v) for v in value_grid(df, value)]).cast("array<double>"), F.col("_v"))
    counts = (df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(F.col(arm) == "b").alias("_cb")))
    run = prefix_frame(counts, [], ["_v"], {"_upto": F.col("_c")}, part)
    mean_rank = F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2
    return run.agg(F.sum(F.col("_cb") * mean_rank).alias("_rb"), F.sum("_cb").alias("_nb"), F.sum("_c").alias("_n"),
                   F.sum(F.pow("_c", F.lit(3)) - F.col("_c")).alias("tie_term")).select(
        (F.col("_rb") - F.col("_nb") * (F.col("_nb") + 1) / 2).alias("u_b"), "tie_term")


def _poisson_one(u: Column) -> Column:
    """Poisson(1) weight of a uniform number, up to 12 (beyond it p < 1e-9)."""
    total, term, bounds = 0.0, math.exp(-1.0), []
    for k in range(13):
        total += term
        bounds.append(total)
        term /= k + 1
    return sum(((u >= b).cast("int") for b in bounds[:12]), F.lit(0))


def bootstrap_interval(df: DataFrame, arm: str, value: str, key: str, draws: int = 1000, level: float = 0.95,
                       buckets: int = 4096, seed: int = 42) -> DataFrame:
    """One row: interval of the mean difference by a Poisson bootstrap.

    Rows are summed into hash buckets first and buckets are drawn, so the draws
    cost the same for any number of rows. Weights are hashes: repeatable.
    """
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(buckets))
    sums = df.filter(F.col(value).isNotNull()).groupBy(F.col(arm).alias("_arm"), bucket.alias("_k")).agg(
        F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c"))
    drawn = sums.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    uniform = F.pmod(F.xxhash64("_arm", "_k", "_draw", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    weighted = drawn.withColumn("_w", _poisson_one(uniform))
    mean = lambda a: F.sum(F.when(F.col("_arm") == a, F.col("_w") * F.col("_s"))) / F.nullif(
        F.sum(F.when(F.col("_arm") == a, F.col("_w") * F.col("_c"))), F.lit(0))
    diffs = weighted.groupBy("_draw").agg((mean("b") - mean("a")).alias("_d"))
    tail = (1 - level) / 2
    return diffs.agg(F.percentile("_d", tail).alias("ci_low"), F.percentile("_d", 1 - tail).alias("ci_high"))  # `draws` values


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + num * d) or 1e-300)
        c = (1.0 + num / c) or 1e-300
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def t_two_sided(t: float, dof: float) -> float:
    if math.isnan(t) or dof <= 0:
        return float("nan")
    return _beta_share(dof / (dof + t * t), dof / 2, 0.5)


def _t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, dof)])


def _normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(a) / math.sqrt(2)) for a in z])


def ab_statistics(df: DataFrame, arm: str, value: str) -> DataFrame:
    """One row of exact statistics: change, pooled t, effect size, U and its z."""
    m = beside(arm_moments(df, arm, value), rank_sum(df, arm, value))
    c = F.col
    diff = c("mean_b") - c("mean_a")
    dof = c("n_a") + c("n_b") - 2
    ratio = F.try_divide  # an empty arm gives nulls
    pooled = ratio(c("n_a") * c("var_a") + c("n_b") * c("var_b"), dof)
    n = c("n_a") + c("n_b")
    centre = c("n_a") * c("n_b") / 2
    spread = F.sqrt(c("n_a") * c("n_b") / 12 * (n + 1 - ratio(c("tie_term"), n * (n - 1))))
    scale = F.sqrt((c("var_a") + c("var_b")) / 2)
    return m.select(
        "n_a", "n_b", "mean_a", "mean_b",
        F.coalesce(ratio(diff, F.abs("mean_a")) * 100, F.lit(0.0)).alias("improvement_pct"),
        ratio(diff, F.sqrt(pooled * (ratio(F.lit(1.0), c("n_a")) + ratio(F.lit(1.0), c("n_b"))))).alias("t"), dof.alias("dof"),
        F.coalesce(ratio(diff, scale), F.lit(0.0)).alias("effect_size"), "u_b",
        ratio(F.abs(c("u_b") - centre) - 0.5, spread).alias("z"))


def ab_compare(df: DataFrame, arm: str, value: str, key: str, test: str = "ttest", level: float = 0.95, draws: int = 1000) -> DataFrame:
    """Statistics, p-value, interval and recommendation; one row.

    With an empty arm the recommendation is ``insufficient_data``.
    """
    stats = beside(ab_statistics(df, arm, value), bootstrap_interval(df, arm, value, key, draws, level))
    if test == "ttest":
        p = F.pandas_udf(_t_p, "double")("t", F.col("dof").cast("double"))
    else:
        p = F.pandas_udf(_normal_p, "double")("z")
    marked = stats.withColumn("p_value", p)
    sure = F.coalesce(F.col("p_value") < 1 - level, F.lit(False))
    gain = F.col("improvement_pct")
    verdict = (F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), "insufficient_data").when(sure & (gain > 5), "deploy")
               .when(sure & (gain < -5), "reject").when(~sure, "inconclusive").otherwise("neutral"))
    return marked.withColumns({"significant": sure, "recommendation": verdict}).drop("dof")
