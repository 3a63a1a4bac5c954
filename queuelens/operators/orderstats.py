"""Exact order statistics without sorting a group in one task.

``percentile`` keeps every distinct value of a group in one task, and a ranking
window moves a whole group to one task. Here the wanted position is narrowed by
counting instead: values are counted per key, the counts are put into magnitude
bins (an expression of the value, so no pass is needed to find bounds), the bin
that holds the wanted position is cut again into equal sub-bins, and only the
few values of the right sub-bin are ordered. Every aggregate combines map-side
and no step holds more than the bins of one key.

Positions among all rows (``boundary_rows``) are narrowed by sketches instead,
each followed by an exact count: two scans of the rows and no shuffle of them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelens.operators.scalars import beside

SUB_BINS = 4096


def magnitude_bin(v: Column) -> Column:
    """A non-decreasing map of doubles to longs, 1024 steps per power of two."""
    a = F.abs(v)
    e = F.floor(F.log2(a))
    step = e * 1024 + F.floor((a / F.pow(F.lit(2.0), e) - 1) * 1024)
    shifted = step + F.lit(1_200_000)
    return (F.when(F.isnan(v), F.lit(9_000_000))
            .when(a == float("inf"), F.signum(v).cast("long") * 8_000_000)
            .when(v == 0, F.lit(0))
            .when(v > 0, shifted).otherwise(-shifted)).cast("long")


def beside_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right``, which has a row per key; null keys are equal, missing ones give nulls."""
    if not keys:
        return beside(left, right)
    others = [c for c in right.columns if c not in keys]
    renamed = right.select(F.struct(*keys).alias("_right_keys"), *others)
    return left.join(renamed, F.struct(*keys).eqNullSafe(F.col("_right_keys")), "left").drop("_right_keys")


def order_stats(df: DataFrame, keys: Sequence[str], value: str,
                picks: dict[str, Callable[[Column], Column]], kind: str = "double") -> DataFrame:
    """Per key the value at each zero-based position, as one column per pick.

    ``picks`` maps a column name to a function from the group's row count to a
    position. Null values are left out; a null key is a key like any other.
    ``kind`` is ``double``, or ``long`` for whole numbers beyond 2^53.
    """
    names, keys = list(keys), ["_k"] if keys else []
    packed = [F.struct(*names).alias("_k")] if names else []  # a struct is joined by equality even where fields are null
    counts = (df.filter(F.col(value).isNotNull())
              .groupBy(*packed, F.col(value).cast(kind).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_b", F.coalesce(magnitude_bin(F.col("_v").cast("double")), F.lit(0))))
    bins = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"),
                                          F.max("_v").alias("_hi"))
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bins.select(*keys, "_b", "_c", "_lo", "_hi", F.sum("_c").over(upto).alias("_end"),
                         F.sum("_c").over(per_key).alias("_n"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), pos(F.col("_n")).cast("long").alias("pos"))
                       for name, pos in picks.items()])
    first = (placed.withColumn("_p", F.explode(wanted))
             .filter((F.col("_p.pos") < F.col("_end")) & (F.col("_p.pos") >= F.col("_end") - F.col("_c")))
             .select(*keys, "_b", "_lo", "_hi", F.col("_p.name").alias("_pick"),
                     (F.col("_p.pos") - F.col("_end") + F.col("_c")).alias("_r")))
    width = F.col("_hi") - F.col("_lo")
    sub = F.when(width > 0, F.floor((F.col("_v") - F.col("_lo")) / width * (SUB_BINS - 1))).otherwise(F.lit(0))
    narrowed = counts.join(first.select(*keys, "_b", "_lo", "_hi").distinct(), [*keys, "_b"]).select(
        *keys, "_b", "_v", "_c", sub.cast("long").alias("_s"))
    in_bin = (Window.partitionBy(*keys, "_b").orderBy("_s")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    subs = (narrowed.groupBy(*keys, "_b", "_s").agg(F.sum("_c").alias("_sc"))
            .withColumn("_end", F.sum("_sc").over(in_bin)))
    second = (subs.join(first.select(*keys, "_b", "_pick", "_r"), [*keys, "_b"])
              .filter((F.col("_r") < F.col("_end")) & (F.col("_r") >= F.col("_end") - F.col("_sc")))
              .select(*keys, "_b", "_s", "_pick", (F.col("_r") - F.col("_end") + F.col("_sc")).alias("_q")))
    in_sub = (Window.partitionBy(*keys, "_b", "_s", "_pick").orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (narrowed.join(second, [*keys, "_b", "_s"])
             .withColumn("_end", F.sum("_c").over(in_sub))
             .filter((F.col("_q") < F.col("_end")) & (F.col("_q") >= F.col("_end") - F.col("_c"))))
    picked = found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_pick") == name, F.col("_v"))).alias(name) for name in picks])
    return picked.select("_k.*", *picks) if names else picked


def position(p: float, shift: int = 0) -> Callable[[Column], Column]:
    """Zero-based position ``int(p * (n + shift))`` clipped to the group."""
    def pos(n: Column) -> Column:
        at = F.floor(F.lit(float(p)) * (n + F.lit(shift)))
        return F.greatest(F.least(at, n - 1), F.lit(0))
    return pos


def linear_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                       shares: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation, one column per entry of ``shares``."""
    picks: dict[str, Callable[[Column], Column]] = {}
    for name, p in shares.items():
        picks[f"_f_{name}"] = lambda n, p=p: F.floor(F.lit(float(p)) * (n - 1))
        picks[f"_c_{name}"] = lambda n, p=p: F.ceil(F.lit(float(p)) * (n - 1))
    found = order_stats(df, keys, value, picks)
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    both = beside_keys(found, sizes, list(keys))
    out = []
    for name, p in shares.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col(f"_f_{name}"), F.col(f"_c_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return both.select(*keys, *out)


GRID = 1024
#: Items of a sketch: its ranks are off by about a thousandth of the rows, one step of the grid.
SKETCH_ITEMS = 4096
MARGIN = 4
#: Rows listed to find a position among them.
SMALL = 20_000


def _grid(value: Column, whole: bool = False) -> Column:
    """Values at ``GRID + 1`` evenly spaced ranks, from a sketch whose size does not depend on the rows."""
    made, read = ((F.kll_sketch_agg_bigint, F.kll_sketch_get_quantile_bigint) if whole
                  else (F.kll_sketch_agg_double, F.kll_sketch_get_quantile_double))
    return read(made(value, F.lit(SKETCH_ITEMS)), F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))


def value_grid(df: DataFrame, value: str) -> list[float]:
    """Distinct values that cut the rows into at most ``GRID`` about equal parts; null and NaN are left out."""
    v = F.col(value).cast("double")
    numbers = F.when(~F.isnan(v), v)
    found = df.agg(F.when(F.count(numbers) > 0, _grid(numbers)).alias("g")).first()["g"]
    return sorted(set(found or []))


@dataclass(frozen=True)
class _Bracket:
    """Values between two bounds (None: none), each with or without its end, that hold about ``rows`` rows."""

    rows: float
    low: float | None = None
    high: float | None = None
    with_low: bool = True
    with_high: bool = True

    def below(self, v: Column) -> Column:
        if self.low is None:
            return F.lit(False)
        return v < F.lit(self.low) if self.with_low else v <= F.lit(self.low)

    def inside(self, v: Column) -> Column:
        above = F.lit(False) if self.high is None else v > F.lit(self.high) if self.with_high else v >= F.lit(self.high)
        return ~self.below(v) & ~above

    @property
    def single(self) -> bool:
        return self.low is not None and self.low == self.high

    def narrowed(self, at: int, inside: int, grid: list) -> _Bracket:
        """The part around position ``at`` of ``inside`` rows whose values at even ranks are ``grid``."""
        step = int(at * GRID / inside)
        first, last = step - MARGIN, step + 1 + MARGIN
        low, with_low = (self.low, self.with_low) if first < 0 else (grid[first], True)
        high, with_high = (self.high, self.with_high) if last > GRID else (grid[last], True)
        steps = (GRID if high is None else bisect_right(grid, high)) - (0 if low is None else bisect_left(grid, low))
        new = _Bracket(inside * min(1.0, (steps + 2) / GRID), low, high, with_low, with_high)
        if (new.low, new.high) == (self.low, self.high):  # few distinct values: try the one at the rank
            return _Bracket(inside, grid[step], grid[step])
        return new


def select_rows(rows: DataFrame, positions: dict[str, int], n: int, whole: bool = False, grid: list | None = None) -> dict[str, tuple]:
    """The (_v, _t) at each zero-based position of ``rows`` ordered by (_v, _t), for ``n`` rows without null or NaN.

    Each round is one scan for all positions. A sketch of the values that are still in question gives a bracket
    around every wanted rank; the next scan counts exactly what lies below and inside it. A bracket of few rows is
    listed in that same scan, a larger one gets a sketch of its own, a single value is settled by its ties, and for
    one that turns out to miss its rank the values beside it are searched. So some millions of rows take two scans,
    each further factor of a hundred one more, and no task holds more than about ``SMALL`` rows for a position.
    ``grid`` is that of all rows, where it is known already.
    """
    v = F.col("_v")
    whole_range = _Bracket(n)
    searched = {k: (p, whole_range, whole_range if grid is None or n <= SMALL else whole_range.narrowed(p, n, grid))
                for k, p in positions.items() if 0 <= p < n}
    found: dict[str, tuple] = {}
    while searched:
        parts = {}
        for k, (_, _, b) in searched.items():
            parts[f"below_{k}"], parts[f"inside_{k}"] = F.count_if(b.below(v)), F.count_if(b.inside(v))
            if b.rows <= SMALL:
                parts[f"list_{k}"] = F.sort_array(F.collect_list(F.when(b.inside(v), F.struct("_v", "_t"))))
            elif not b.single:
                parts[f"grid_{k}"] = F.when(F.count_if(b.inside(v)) > 0, _grid(F.when(b.inside(v), v), whole))
        made = rows.agg(*[c.alias(name) for name, c in parts.items()]).first()
        after = {}
        for k, (p, outer, b) in searched.items():
            below, inside = made[f"below_{k}"], made[f"inside_{k}"]
            at = p - below
            if at < 0:
                beside = _Bracket(below, outer.low, b.low, outer.with_low, not b.with_low)
                after[k] = (p, beside, beside)
            elif at >= inside:
                beside = _Bracket(n - below - inside, b.high, outer.high, not b.with_high, outer.with_high)
                after[k] = (p, beside, beside)
            elif b.rows <= SMALL:
                found[k] = tuple(made[f"list_{k}"][at])
            elif b.single:
                ties = rows.filter(v == F.lit(b.low)).select(F.col("_t").alias("_v"), F.lit(0).alias("_t"))
                found[k] = (b.low, select_rows(ties, {k: at}, inside, True)[k][0])
            else:
                after[k] = (p, b, b.narrowed(at, inside, made[f"grid_{k}"]))
        searched = after
    return found


def boundary_rows(df: DataFrame, value: str, tie: str,
                  picks: dict[str, Callable[[Column], Column]]) -> dict[str, tuple[float, int] | None]:
    """The ``(value, tie)`` pair at each wanted global position.

    Equal values are told apart by ``tie`` (a unique whole number). Only these
    few pairs reach the driver; with them a row's side of each cut is a plain
    comparison with constants, so no row ever needs a global rank. A position
    past the end gives None. Null values are left out, NaN is the largest value.
    """
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull()).select(v.alias("_v"), F.col(tie).cast("long").alias("_t"))
    numbers = F.when(~F.isnan("_v"), F.col("_v"))
    sizes = rows.agg(F.count(F.lit(1)).alias("_n"), F.count(numbers).alias("_m"), F.when(F.count(numbers) > 0, _grid(numbers)).alias("_g"))
    top = sizes.select("*", *[pos(F.col("_n")).cast("long").alias(f"_p_{k}") for k, pos in picks.items()]).first()
    n, m = top["_n"], top["_m"]
    wanted = {k: top[f"_p_{k}"] for k in picks if top[f"_p_{k}"] is not None}
    found = select_rows(rows.filter(~F.isnan("_v")), {k: p for k, p in wanted.items() if p < m}, m, grid=top["_g"])
    beyond = {k: p - m for k, p in wanted.items() if m <= p < n}
    if beyond:
        ties = rows.filter(F.isnan("_v")).select(F.col("_t").alias("_v"), F.lit(0).alias("_t"))
        found |= {k: (float("nan"), pair[0]) for k, pair in select_rows(ties, beyond, n - m, True).items()}
    return {k: (float(found[k][0]), int(found[k][1])) if k in found else None for k in picks}
