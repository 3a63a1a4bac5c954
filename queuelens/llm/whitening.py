"""Whitening of embeddings: blockwise QR over all rows, then a bidiagonal qd solver on the factor that is left.

Every task reduces its centred rows, block by block, to one triangular factor; factors are joined in a tree until one
is left, whose size is that of a vector squared. Its singular values and directions (see ``bidiagonal``) are those of
all rows. No covariance is ever squared up, so small directions keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.bidiagonal import largest_directions
from queuelens.session import cut_lineage

SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this take part as this; their squares could not be returned as longs anyway.
LARGEST = float(1 << 40)
BLOCK_ROWS = 4096
JOINED_AT_ONCE = 16


@dataclass(frozen=True)
class Whitening:
    """What a fit learns: ``n`` rows, exact ``sums`` per dimension, directions as columns, their variances."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float


def whole_numbers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): each entry c as ``floor(64 * c) + 1000000``, for rows whose vector is there and wholly finite."""
    c = F.col(vector).cast("array<double>")
    sound = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    bounded = lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v * SCALE))
    return vectors.filter(sound).select(F.col(key).alias("id"), F.transform(c, lambda v: F.floor(bounded(v)) + OFFSET).alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _sums(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(size, dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            n, sums = n + len(x), sums + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in sums]])], ["n", "sums"])

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n with one rounding: the whole part of the mean is taken off exactly."""
    whole = sums // n
    part = np.array([int(s) for s in sums - whole * n], dtype=float) / n
    return (x - whole.astype(np.int64)).astype(float) - part


def _factors(size: int, n: int, sums: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, waiting, rows = np.zeros((0, size)), [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                waiting.append(_centred(_matrix(batch.column(0).slice(start, BLOCK_ROWS), size), n, sums))
                rows += len(waiting[-1])
                if rows >= BLOCK_ROWS:
                    factor, waiting, rows = np.linalg.qr(np.vstack([factor, *waiting]), mode="r"), [], 0
        if len(factor) or waiting:
            factor = np.linalg.qr(np.vstack([factor, *waiting]), mode="r")
            yield pa.RecordBatch.from_arrays([pa.array([factor.ravel().tolist()])], ["factor"])

    return run


def _join_factors(size: int):
    def run(pdf):
        stacked = np.vstack([np.asarray(f).reshape(-1, size) for f in pdf["factor"]])
        return pdf[["part"]].head(1).assign(factor=[np.linalg.qr(stacked, mode="r").ravel().tolist()])

    return run


def _products(size: int, n: int, sums: np.ndarray, turned: np.ndarray):
    """Sums and products of whitened rows, one list per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            w = _centred(_matrix(batch.column(0), size), n, sums) @ turned
            new = np.vstack([w.sum(axis=0), w.T @ w])
            total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["products"])

    return run


def fit_whitening(rows: DataFrame, components: int = 32) -> Whitening | None:
    """The leading directions of all vectors of ``whole_numbers``; None where no row is left.

    Vectors of another length than the commonest (of equally common ones the longest) take no part. Directions
    whose variance is below 1e-12 of the largest are none: a constant table has no component. What reaches the
    driver is a count, the sums, one triangular factor and the products of the whitened components; all have the
    size of one vector, or of a vector squared (64 entries: 32 KB).
    """
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return None
    size = sizes["size"]
    lean = rows.filter(F.size("x") == size).select("x")
    added = lean.mapInArrow(_sums(size), "n bigint, sums array<string>")
    totals = (added.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i")
              .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect())
    n, sums = int(totals[0]["n"]), np.array([int(t["s"]) for t in totals], dtype=object)

    factors = cut_lineage(lean.mapInArrow(_factors(size, n, sums), "factor array<double>")
                          .withColumn("part", F.monotonically_increasing_id()))
    left = factors.count()
    while left > 1:
        numbered = factors.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(max(1, left // JOINED_AT_ONCE))))
        factors = cut_lineage(numbered.groupBy("part").applyInPandas(_join_factors(size), "part bigint, factor array<double>"))
        left = factors.count()
    r = np.asarray(factors.first()["factor"]).reshape(-1, size)
    if len(r) < size:
        r = np.vstack([r, np.zeros((size - len(r), size))])
    squares, directions, total = largest_directions(r, components)
    k = len(squares)
    if k == 0:
        return Whitening(n, sums, directions, squares, 0.0, 0.0)
    turned = directions / np.sqrt(squares / n)
    made = (lean.mapInArrow(_products(size, n, sums, turned), "products array<double>")
            .select(F.posexplode("products").alias("i", "p")).groupBy("i").agg(F.sum("p").alias("p")).orderBy("i").collect())
    made = np.array([m["p"] for m in made]).reshape(k + 1, k) / n
    covariance = made[1:] - np.outer(made[0], made[0])
    return Whitening(n, sums, directions, squares / n, total / n, float(np.abs(covariance - np.eye(k)).max()))


def _whitened(fit: Whitening):
    size = len(fit.sums)
    turned = fit.directions / np.sqrt(fit.variances)

    def deviations(x: np.ndarray) -> list[int | None]:
        whole = fit.sums // fit.n
        rest = (fit.sums - whole * fit.n)
        near = x - whole.astype(np.int64)
        reach = (int(np.abs(near).max(initial=0)) + 1) * fit.n
        if reach * reach * size < 1 << 63:
            return (((near * fit.n - rest.astype(np.int64)) ** 2).sum(axis=1)).tolist()
        exact = ((near.astype(object) * fit.n - rest) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                x = _matrix(part.column(1), size)
                w = _centred(x, fit.n, fit.sums) @ turned
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviations(x), pa.int64()), lists], ["id", "deviation", "w"])

    return run


def apply_whitening(rows: DataFrame, fit: Whitening | None, key: str = "vec_id") -> DataFrame:
    """One row per vector of ``rows`` and component: ``key``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``. ``deviation`` (sum over dimensions of (n*x - S)^2) is null beyond a long.
    """
    kind = rows.schema["id"].dataType.simpleString()
    if fit is None or not len(fit.variances):
        names = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], names)
    made = (rows.filter(F.size("x") == len(fit.sums)).select("id", "x")
            .mapInArrow(_whitened(fit), f"id {kind}, deviation bigint, w array<double>"))
    shares = F.array(*[F.lit(float(v / fit.total)) for v in fit.variances])
    return (made.select("id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        F.col("id").alias(key), (F.col("i") + 1).cast("int").alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation",
        "whitened", shares[F.col("i")].alias("explained"), F.lit(fit.identity_error).alias("identity_error")))


def whiten(vectors: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each vector's coordinates along the leading directions, scaled to unit variance.

    Null vectors, vectors with a null or non-finite entry and empty ones are left out; so are those of another length
    than the commonest. Repeated rows and equal ids count as often as they occur; null ids are kept. Equal variances
    give some orthogonal choice of directions, the same for all rows. Other columns, whatever their names, are not
    read. Long vectors cost their length squared in memory per task (1,000 entries: 8 MB).
    """
    rows = whole_numbers(vectors, key, vector)
    return apply_whitening(rows, fit_whitening(rows, components), key)
