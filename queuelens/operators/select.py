"""Orders, limits, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelens.operators.orderstats import boundary_rows
from queuelens.operators.slices import limit_early


def priority_order(tasks: DataFrame, queue: Column, k: int) -> DataFrame:
    """Next k tasks of each queue: highest priority, then oldest, then id.

    Each map task keeps only k rows per queue before the shuffle.
    """
    limit_early(tasks, k)
    spec = Window.partitionBy("queue_key").orderBy(F.col("priority").desc(), "created_at", "task_id")
    return (tasks.withColumn("queue_key", queue).withColumn("place", F.row_number().over(spec))
            .filter(F.col("place") <= k))


def top_contributors(df: DataFrame, contributions: dict[str, Column], k: int, keep: Sequence[str]) -> DataFrame:
    """The k features with the largest absolute contribution of each row.

    Sorted within the row's own array: no shuffle.
    """
    items = F.array(*[F.struct((-F.abs(c)).alias("rank"), F.lit(n).alias("feature"), c.alias("contribution"))
                      for n, c in contributions.items()])
    best = F.slice(F.array_sort(items), 1, k)
    return df.select(*keep, F.explode(best).alias("_x")).select(*keep, "_x.feature", "_x.contribution")


def hash_share(id_col: str, seed: int) -> Column:
    """Repeatable 52-bit hash of an id, exact as a double."""
    text = F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def split_rows(df: DataFrame, shares: Sequence[float], seed: int, id_col: str,
               names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Exact shuffled split: int(n * share) rows each, the last part takes the rest.

    Shares are renormalised. Rows are told apart by a seeded hash; only the rows
    at the cuts are looked up, so nothing is sorted.
    """
    total = sum(shares)
    cuts, run = {}, []
    for i, share in enumerate(shares[:-1]):
        run = [*run, share / total]
        cuts[f"_cut{i}"] = lambda n, run=tuple(run): sum((F.floor(n * F.lit(s)) for s in run), F.lit(0))
    hashed = df.withColumn("_h", hash_share(id_col, seed))
    edges = boundary_rows(hashed, "_h", id_col, cuts)
    label = F.lit(names[len(shares) - 1])
    for i in reversed(range(len(shares) - 1)):
        edge = edges[f"_cut{i}"]
        before = F.lit(True) if edge is None else (F.col("_h") < edge[0]) | (
            (F.col("_h") == edge[0]) & (F.col(id_col) < edge[1]))
        label = F.when(before, names[i]).otherwise(label)
    return hashed.withColumn("part", label).drop("_h")


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in b.columns if c in a.columns]


def shared_profile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared columns with their filled rows on either side."""
    cols = shared_columns(a, b)
    side = lambda df, tag: df.agg(*[F.count(c).alias(c) for c in cols]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias(tag)) for c in cols])).alias("x")).select("x.*")
    return side(a, "filled_a").join(side(b, "filled_b"), "column")
