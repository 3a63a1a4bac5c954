"""Mixing sources to target weights by entropy balancing.

Each document gets a rate; among all rates that give every source its target number of words the ones nearest to 1
in relative entropy, held below ``cap``, are ``min(cap, exp(lambda_source * size))``. The multipliers solve the
convex dual, one constraint per source, by Newton steps on the sums of each source. The sums need only the number
of documents per (source, size), which is counted once; every step is a join and an aggregation over that table.
The rates are then rounded into whole copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.llm.common import word_array
from queuelens.session import cut_lineage

#: Documents of one (source, size) ranked together.
RANKED_TOGETHER = 2_000
STEPS = 40
CLOSE = 1e-7


def source_targets(sizes: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the sum of all sizes by weight and
    stop at ``cap`` times their source's size. Sources are taken by growing capacity per weight: each either
    takes its capacity or, with all after it, an even share of what is left.
    """
    ordered = sizes.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weighed = ordered.withColumn("_weight", ((F.col("_rank") - 1) % 3 + 1).cast("double")).withColumn("_limit", cap * F.col("source_size"))
    line = W.orderBy((F.col("_limit") / F.col("_weight")).asc(), F.col("_rank"))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shares = weighed.select("*", F.sum("source_size").over(whole).cast("double").alias("_total"),
                            F.coalesce(F.sum("_limit").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"),
                            F.sum("_weight").over(line.rowsBetween(0, W.unboundedFollowing)).alias("_after"))
    level = (F.col("_total") - F.col("_before")) / F.col("_after")
    # the level rises while sources are capped and is settled at the first that is not
    levels = shares.withColumn("_level", level)
    free = F.when(F.col("_level") * F.col("_weight") <= F.col("_limit"),
                  F.struct((F.col("_limit") / F.col("_weight")).alias("r"), F.col("_rank").alias("k"), F.col("_level").alias("level")))
    final = levels.withColumn("_first", F.min(free).over(whole))
    return final.select("source", "source_size",
                        F.when(F.col("_first").isNull(), F.col("_limit"))
                        .otherwise(F.least(F.col("_limit"), F.col("_first.level") * F.col("_weight"))).alias("target"))


def _tilt(cap: float, size: str = "size") -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("_lambda") * F.col(size) / F.col("_scale"), F.lit(50.0))))


def balance(counts: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(source, _lambda, _scale) that meet the targets, from (source, size, n) and (source, source_size, target).

    Newton steps, each kept inside the bracket known so far; the sum is monotone in the multiplier. ``_scale`` is
    the mean size weighted by words, so multipliers are of order one.
    """
    square = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * F.col("size")).alias("_sq"))
    state = cut_lineage(targets.alias("t").join(square.alias("q"), F.col("t.source").eqNullSafe(F.col("q.source"))).select(
        "t.source", "t.source_size", "t.target", F.greatest(F.coalesce(F.try_divide(F.col("_sq"), F.col("source_size")), F.lit(1.0)), F.lit(1.0)).alias("_scale"),
        F.lit(0.0).alias("_lambda"), F.lit(-1e9).alias("_low"), F.lit(1e9).alias("_high"), F.lit(1.0).alias("_gap")))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)  # every document at the cap
    for _ in range(STEPS):
        rate = _tilt(cap)
        sums = counts.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).groupBy("s.source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("_sum"),
            F.sum(F.when(rate < cap, F.col("n") * F.col("size") * F.col("size") / F.col("_scale") * rate).otherwise(0.0)).alias("_slope"))
        gap = F.col("_sum") - F.col("target")
        low = F.when(gap < 0, F.col("_lambda")).otherwise(F.col("_low"))
        high = F.when(gap > 0, F.col("_lambda")).otherwise(F.col("_high"))
        newton = F.col("_lambda") - F.try_divide(gap, F.col("_slope"))
        newton = F.greatest(F.col("_lambda") - 8.0, F.least(F.col("_lambda") + 8.0, newton))
        middle = (F.greatest(low, F.col("_lambda") - 16.0) + F.least(high, F.col("_lambda") + 16.0)) / 2
        step = F.when((gap == 0) | full | (F.col("source_size") == 0), F.col("_lambda")).when(
            F.coalesce((newton > low) & (newton < high), F.lit(False)), newton).otherwise(middle)
        error = F.when(full | (F.col("source_size") == 0), 0.0).otherwise(F.abs(gap) / F.col("target"))
        state = cut_lineage(state.alias("s").join(sums.alias("x"), F.col("s.source").eqNullSafe(F.col("x.source"))).select(
            "s.source", "source_size", "target", "_scale",
            F.when(full, F.lit(1e9)).when(error <= CLOSE, F.col("_lambda")).otherwise(step).alias("_lambda"),
            low.alias("_low"), high.alias("_high"), error.alias("_gap")))
        worst = state.agg(F.max("_gap")).first()[0]
        if worst is None or worst <= CLOSE:
            break
    return state.select("source", "_lambda", "_scale", "target", "source_size")


def _round_down_sizes(cap: float):
    """Whole copies for each size of one source, largest first, carrying the words left over to the next size."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False, kind="stable")
        left, out = 0.0, np.zeros(len(rows), np.int64)
        for i, (size, n, rate) in enumerate(zip(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist(), strict=True)):
            if size == 0:
                out[i] = n
                continue
            want = n * rate * size + left
            out[i] = min(int(cap) * n, max(0, round(want / size)))
            left = want - out[i] * size
        rows["m"] = out
        return rows[["source", "size", "n", "m"]]

    return of


def mix_sources(docs: DataFrame, cap: int = 3, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """All documents with the number of ``copies`` the mix takes of each.

    Columns: key, size, source_size, target, copies, taken. Sizes are numbers of words, 0 for null texts. ``source``
    may be null: such rows form one source. Documents without words are taken once. Within a source the copies of
    each size are settled first, one small row per distinct size, so that the words taken are off its target by
    no more than about half of its smallest text; which documents of a size get them is decided by the hash of
    the id, and equal rows may share ranks, which changes no sum. Reruns give the same rows. An empty table gives an
    empty result.
    """
    slim = cut_lineage(docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("source"),
                                   F.size(word_array(text)).cast("long").alias("size")))
    counts = cut_lineage(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    state = balance(counts, source_targets(totals, float(cap)), float(cap))
    rated = counts.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select(
        F.col("c.source").alias("source"), "size", "n", _tilt(cap).alias("rate"))
    plan = rated.groupBy("source").applyInPandas(_round_down_sizes(cap), "source string, size long, n long, m long")
    plan = plan.alias("p").join(state.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        F.col("p.source").alias("_source"), F.col("size").alias("_size"), "n", "m", "source_size", "target")
    plan = cut_lineage(plan)
    placed = slim.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    order = F.xxhash64(F.lit("mix"), F.col("_key"))
    part = F.pmod(F.xxhash64("_order"), F.ceil(F.col("n") / RANKED_TOGETHER))
    placed = placed.withColumn("_order", order).withColumn("_part", F.struct("source", "size", part.alias("part")))
    # ranks run through the parts of a size: each part starts where the one before it ends
    held = placed.filter(F.col("n") > RANKED_TOGETHER).groupBy("_part").agg(F.count(F.lit(1)).alias("held"))
    along = W.partitionBy("_part.source", "_part.size").orderBy("_part.part").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select(F.col("_part").alias("_of"), F.coalesce(F.sum("held").over(along), F.lit(0)).alias("_start"))
    placed = placed.join(starts, F.col("_part") == F.col("_of"), "left")
    rank = F.coalesce("_start", F.lit(0)) + F.row_number().over(W.partitionBy("_part").orderBy("_order", "_key")).cast("long")
    upto = lambda k: (F.col("m") * k - F.pmod(F.col("m") * k, F.col("n"))) / F.col("n")
    copies = (upto(rank) - upto(rank - 1)).cast("long")
    return placed.select(F.col("_key").alias(key), "size", "source_size", F.col("target").cast("double").alias("target"), copies.alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies"))
