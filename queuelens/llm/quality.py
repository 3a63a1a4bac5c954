"""Quality by compression: text compresses best with a dictionary of its own kind.

Two zstandard dictionaries are built, from good and from bad labelled texts. A text is compressed with each, in
blocks small enough that the dictionary keeps its weight in long texts. The difference of the two sizes, normalised
by the size with either and by the bare size of the text, is calibrated into a probability by logistic regression on
labelled texts that are in neither dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import held_out, label_of, labelled_sample, nothing_kept
from queuelens.llm.fitting import apply_logistic, fit_logistic

BLOCK = 1024
LEVEL = 3
CUTOFF = 0.3


@dataclass
class QualityModel:
    """Dictionaries as bytes, so that it travels to the tasks; ``logistic`` is None where only one label was seen."""

    good: bytes
    bad: bytes
    logistic: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    prior: float

    def features(self) -> Callable[[str | None], list[float]]:
        packers = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False).compress)
        plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
        by_good, by_bad = packers

        def of(text: str | None) -> list[float]:
            body = (text or "").encode()
            n = max(len(body), 1)
            blocks = [body[i:i + BLOCK] for i in range(0, len(body), BLOCK)] or [b""]
            good, bad = sum(len(by_good(b)) for b in blocks), sum(len(by_bad(b)) for b in blocks)
            difference, size = (bad - good) / (bad + good), np.log(n)
            return [difference, difference * abs(difference), (bad - good) / n, good / n, len(plain(body)) / n, size, difference * size]

        return of

    def score(self, features: np.ndarray) -> np.ndarray:
        return np.full(len(features), self.prior) if self.logistic is None else apply_logistic(self.logistic, features)


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train on."""
    blocks = [b[i:i + BLOCK] for b in (t.encode() for t in texts) for i in range(0, len(b), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-size:]


def train(docs: DataFrame, marks: DataFrame, per_label: int = 1600, max_bytes: int = 32_768, dictionary_bytes: int = 65_536,
          text: str = "text", key: str = "doc_id") -> QualityModel:
    """Learn from at most ``per_label`` labelled rows of each label, held-out rows excluded.

    Even places of the sample's order go to the dictionaries, odd ones to the calibration, weighted by the share of
    their label among all training labels.
    """
    sample = labelled_sample(docs, marks, "quality", per_label, max_bytes, text, key).toPandas().sort_values(["_order", "_text"])
    counts = {r["_label"]: r["count"] for r in label_of(marks, "quality", key).filter(~held_out(key)).groupBy("_label").count().collect() if r["_label"] in (0, 1)}
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    parts = {k: sample[sample["_label"] == k]["_text"].tolist() for k in (0, 1)}
    model = QualityModel(_dictionary(parts[1][::2], dictionary_bytes), _dictionary(parts[0][::2], dictionary_bytes), None, prior)
    held = {k: v[1::2] for k, v in parts.items()}
    if all(held.values()):
        of = model.features()
        x = np.array([of(t) for k in (0, 1) for t in held[k]])
        y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
        weight = np.where(y == 1, prior / len(held[1]), (1 - prior) / len(held[0])) * len(y)
        model.logistic = fit_logistic(x, y, weight, 1e-3)
    return model


def _scored(model: QualityModel) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing_kept()
        of = model.features()
        for rows in batches:
            if len(rows):
                text = rows.pop("_text")
                yield rows.assign(score=model.score(np.array([of(t) for t in text])))

    return run


def score_quality(docs: DataFrame, model: QualityModel, cutoff: float = CUTOFF, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every whole text; null texts are scored as empty, null ids count as held out.

    Repeated rows get equal scores; other columns are not read; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text).alias("_text")).mapInPandas(
        _scored(model), f"`{key}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, cutoff: float = CUTOFF, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``cutoff``, with all their columns; only the text goes to Python."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        nothing_kept()
        of = model.features()
        for texts in batches:
            yield pd.Series(model.score(np.array([of(t) for t in texts])) if len(texts) else [], dtype=float)

    return docs.filter(score(F.col(text)) >= cutoff)
