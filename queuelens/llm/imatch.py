"""Document fingerprints by I-Match over randomised lexicons.

The lexicon is made of the terms whose share of documents lies within a band (that is, whose inverse document
frequency does): very common terms say nothing and very rare ones are mostly noise. Each draw takes a random part of
the lexicon, a smaller one each time, and divides it into disjoint subsets; a subset's hash covers the sorted
distinct terms that a text has of it. A fingerprint is the row of these hashes. Changing a term changes only the
hashes of its subsets, so the share of equal hashes tells how alike two texts are; it is read from the smallest draw
that has enough subsets in use, so that long and short texts are measured alike.

At most ``(mean number of distinct terms) / low`` terms can reach the lower end of the band, whatever the number of
documents, which bounds the lexicon that is sent to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import WordHashes, mixed
from queuelens.session import cut_lineage

#: Share of documents that lexicon terms occur in; draws, how much smaller each is, subsets of a draw, and how many must be in use.
LOW, HIGH, DRAWS, THINNER, SUBSETS, USED = 1 / 1000, 0.25, 4, 8, 64, 16
#: Terms counted by a task before it hands over its counts.
COUNTED = 500_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
EMPTY = 0


def _terms(text: str, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the words, A-Z lowered."""
    return np.unique(hashes(text.encode().translate(LOWER).split()))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers of documents per term within what a task has read so far."""
    hashes, held, size = WordHashes(), [], 0

    def summed() -> pd.DataFrame:
        terms, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"term": terms.view(np.int64), "n": n.astype(np.int64)})

    for rows in batches:
        for text in rows["text"].dropna():
            held.append(_terms(text, hashes))
            size += len(held[-1])
            if size >= 8 * COUNTED:
                yield summed()
                held, size = [], 0
    if held:
        yield summed()


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, text: str = "text") -> np.ndarray:
    """Sorted hashes of the terms in the band, counted over all documents."""
    counts = cut_lineage(docs.select(F.col(text).alias("text")).mapInPandas(_counted, "term long, n long")
                         .groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") > 1))
    total = docs.count()
    band = counts.filter((F.col("n") >= low * total) & (F.col("n") <= high * total)).select("term").toPandas()["term"]
    return np.sort(band.to_numpy(np.int64).view(np.uint64))


def _subsets(terms: np.ndarray) -> np.ndarray:
    """Subset of each term in each draw, -1 where the draw leaves the term out."""
    seeds = np.arange(1, DRAWS + 1, dtype=np.uint64)[:, None]
    size = np.uint64(SUBSETS) * np.uint64(THINNER) ** np.arange(DRAWS, dtype=np.uint64)[:, None]
    at = ((mixed(terms[None, :] + mixed(seeds)) >> np.uint64(32)) % size).astype(np.int64)
    return np.where(at < SUBSETS, at + SUBSETS * np.arange(DRAWS)[:, None], -1)


class Fingerprints:
    """Rows of subset hashes over one lexicon."""

    def __init__(self, terms: np.ndarray):
        self.terms, self.hashes = terms, WordHashes()
        self.subset, self.value = _subsets(terms), mixed(terms)

    def of(self, text: str) -> np.ndarray:
        """DRAWS * SUBSETS hashes of 16 bits; a subset of which the text has no term is EMPTY.

        A text with fewer than USED lexicon terms uses all of its terms instead.
        """
        found = _terms(text, self.hashes)
        at = np.searchsorted(self.terms, found)
        at[at == len(self.terms)] = 0
        mine = at[self.terms[at] == found] if len(self.terms) else at[:0]
        subset, value = (self.subset[:, mine], self.value[mine]) if len(mine) >= USED else (_subsets(found), mixed(found))
        flat = subset.ravel()
        used = np.flatnonzero(flat >= 0)  # in each draw still by sorted term
        used = used[np.argsort(flat[used], kind="stable")]
        out = np.zeros(DRAWS * SUBSETS, "<u2")
        if len(used):
            members, starts = np.unique(flat[used], return_index=True)
            place = np.arange(len(used)) - np.repeat(starts, np.diff(np.r_[starts, len(used)]))
            chained = mixed(value[used % len(value)] + place.astype(np.uint64))
            out[members] = np.maximum(mixed(np.add.reduceat(chained, starts)) >> np.uint64(48), np.uint64(1))
        return out


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes among the subsets that either text has terms of; 1 for two texts without any."""
    used = ((a != EMPTY) | (b != EMPTY)).reshape(DRAWS, SUBSETS)
    n = used.sum(axis=1)
    if not n[0]:
        return 1.0
    draw = max([0, *np.flatnonzero(n >= USED).tolist()])
    return float((a == b).reshape(DRAWS, SUBSETS)[draw][used[draw]].sum()) / int(n[draw])


def edited(text: str, following: str) -> str:
    """The last third of the text gives way to as much of the beginning of the other."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _compared(send: object, key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows in their order, each with the next. The first row of a partition also hands out its ``head``, and the last
    one waits with its ``tail`` for the head of the partition that follows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Fingerprints(send.value)
        before, head = None, None
        for rows in batches:
            out = []
            for doc, text in zip(rows["doc"].tolist(), rows["text"].fillna("").tolist(), strict=True):
                now = (doc, text, make.of(text))
                if before is None:
                    head = text
                else:
                    out.append(_row(make, before, text, now[2]))
                before = now
            if out:
                yield _frame(out)
        if before is not None:
            yield _frame([(before[0], len(before[1]), None, before[2].tobytes(), None, None, None, head, before[1])])

    return run


def _row(make: Fingerprints, row: tuple, following: str, next_print: np.ndarray) -> tuple:
    doc, text, mine = row
    changed = edited(text, following)
    other = make.of(changed)
    return (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), mine.tobytes(), other.tobytes(),
            alike(mine, other), alike(mine, next_print), None, None)


COLUMNS = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "head", "tail"]
SCHEMA = ("doc long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, "
          "near_next double, head string, tail string")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=COLUMNS)
    return made.astype({"doc": "Int64", "near_edited": "float64", "near_next": "float64"})


def fingerprints(docs: DataFrame, spark: SparkSession, low: float = LOW, high: float = HIGH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and how alike it is to that and to the next text.

    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next text is that
    of the next smaller id, the one of the largest id after the last; ids must be whole numbers, a null id comes last,
    equal ids are ordered by their text. Null texts count as empty; texts without terms have an empty fingerprint,
    and two of these are alike. The rows are dealt by id ranges once; only the one row at the end of each part
    waits for the part that follows. An empty table gives an empty result; other columns are not read.
    """
    send = spark.sparkContext.broadcast(lexicon(docs, low, high, text))
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    order = [F.col("doc").desc_nulls_last(), F.coalesce("text", F.lit("")).asc()]
    dealt = rows.repartitionByRange(order[0]).sortWithinPartitions(*order)
    made = cut_lineage(dealt.mapInPandas(_compared(send, key), SCHEMA).withColumn("part", F.spark_partition_id()))
    ends = made.filter(F.col("tail").isNotNull()).select("doc", "n_chars", "fingerprint", "head", "tail", "part")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Fingerprints(send.value)
        for part in batches:
            out = [_row(make, (d, t, np.frombuffer(f, "<u2")), h, make.of(h))
                   for d, t, f, h in zip(part["doc"].tolist(), part["tail"], part["fingerprint"], part["following"], strict=True)]
            if out:
                yield _frame(out)

    # one row per part: the part after each, the first one after the last
    heads = ends.select("part", "head")
    numbers = ends.select("part").toPandas()["part"].sort_values().tolist()
    after = dict(zip(numbers, numbers[1:] + numbers[:1], strict=True))
    pairs = spark.createDataFrame(list(after.items()) or [(-1, -1)], "part int, then int")
    closing = (ends.drop("head").join(pairs, "part").join(heads.select(F.col("part").alias("then"), F.col("head").alias("following")), "then")
               .select("doc", "tail", "fingerprint", "following").mapInPandas(close, SCHEMA))
    whole = made.filter(F.col("tail").isNull()).drop("part").unionByName(closing).drop("head", "tail")
    text_of = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return whole.withColumns(text_of).withColumnRenamed("doc", key)
