"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
HOLDOUT_EVERY = 5
#: Words remembered by one task; the memory is emptied beyond it.
MEMO_WORDS = 400_000
#: What this process keeps from task to task: one thing, with its name.
_KEPT: dict[Any, Any] = {}


def kept_by_worker(name: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gave for this name, if no task of the worker has asked for another name since.

    Workers outlive their tasks and stages, and all of one executor share its memory, so what an operator remembers
    is dropped as soon as the worker turns to another one.
    """
    if name not in _KEPT:
        nothing_kept()
        _KEPT[name] = make()
    return _KEPT[name]


def nothing_kept() -> None:
    """For operators that remember nothing from task to task: what the worker kept for others is dropped."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()  # memories refer to their owners


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def word_array(text: str | Column) -> Column:
    """Words between ASCII white space; empty for null or blank text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def held_out(key: str = "doc_id") -> Column:
    """True for rows that no model may learn from: crc32 of the id as text, modulo 5, is 0. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % HOLDOUT_EVERY == 0, F.lit(True))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with marks behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def label_of(marks: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """One (key, _label) per id: rows without an id or label are left out, the larger of two labels holds."""
    return (marks.filter(F.col(key).isNotNull() & F.col(name).isNotNull())
            .groupBy(F.col(key)).agg(F.max(F.col(name).cast("int")).alias("_label")))


def labelled_sample(docs: DataFrame, marks: DataFrame, name: str, per_label: int, max_bytes: int, text: str = "text",
                    key: str = "doc_id") -> DataFrame:
    """At most ``per_label`` training rows of each label, in an order fixed by the hash of the id.

    Columns ``_label``, ``_text``, ``_order``. Held-out rows, null texts and texts of over ``max_bytes``
    are not drawn, so the driver holds at most ``2 * per_label * max_bytes`` bytes.
    """
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.lit(name), F.col(key)).alias("_order")).filter(
        ~held_out("_id") & (F.octet_length("_text") <= max_bytes))
    # ids are drawn without their texts, which are then fetched for at most 2 * per_label ids
    able = rows.select("_id", "_order").join(label_of(marks, name, key).withColumnRenamed(key, "_id"), "_id")
    first = [able.filter(F.col("_label") == k).orderBy("_order", "_id").limit(per_label) for k in (0, 1)]
    ids = first[0].unionByName(first[1]).select("_id", "_label").distinct()
    drawn = rows.join(F.broadcast(ids), "_id").select("_label", "_text", "_order", "_id")
    ordered = [drawn.filter(F.col("_label") == k).orderBy("_order", "_id", "_text").limit(per_label) for k in (0, 1)]
    return ordered[0].unionByName(ordered[1]).drop("_id")


class WordHashes:
    """64-bit hashes of words, each worked out once and kept while the memory is small."""

    def __init__(self, limit: int = MEMO_WORDS):
        self.limit = limit
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > self.limit:
                known.clear()
                new = set(words)
            digest = xxhash.xxh3_64_intdigest
            known.update((w, digest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble (two multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(lengths)
    return zip((ends - lengths).tolist(), ends.tolist(), strict=True)
