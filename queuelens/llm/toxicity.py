"""Toxic spans by a linear-chain conditional random field.

Labels mark whole documents. Words, word beginnings that stand out in toxic documents mark tokens: a token of a toxic
document that has such a trait is labelled toxic, all others are not. A two-state chain is trained on these tokens
by the gradient of its log-likelihood. In use, forward-backward gives every token its marginal probability of
being toxic; a document's score is calibrated from its marginals, and runs of likely tokens are its toxic spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import MEMO_WORDS, held_out, label_of, labelled_sample
from queuelens.llm.fitting import apply_logistic, fit_logistic

#: Words of one chain; weights of the hashed traits; word beginnings that are traits; texts worked on together.
CHAIN, SLOTS, PREFIXES, TOGETHER = 64, 1 << 18, (4, 5), 256
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CUTOFF = 0.5


def traits(word: bytes) -> list[int]:
    """Slots of a token's own traits, then as left and as right neighbour."""
    bare = word.translate(LOWER).strip(EDGES) or word
    slot = lambda kind, x: xxhash.xxh3_64_intdigest(x, seed=kind) % SLOTS
    return [slot(1, bare), *[slot(10 + n, bare[:n]) for n in PREFIXES], slot(2, bare), slot(3, bare)]


OWN = 1 + len(PREFIXES)


def marginals(emission: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(token is toxic) and P(pair of states at neighbours) of padded chains; emission is the toxic state's score."""
    n, width = emission.shape
    logit = np.zeros((n, width, 2))
    logit[:, :, 1] = emission
    inside = np.arange(width) < lengths[:, None]
    forward, backward = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    forward[:, 0] = start + logit[:, 0]
    for t in range(1, width):
        x = forward[:, t - 1, :, None] + trans
        forward[:, t] = np.logaddexp(x[:, 0], x[:, 1]) + logit[:, t]
    for t in range(width - 2, -1, -1):
        x = trans + (logit[:, t + 1] + backward[:, t + 1])[:, None, :]
        backward[:, t] = np.where(inside[:, t + 1, None], np.logaddexp(x[:, :, 0], x[:, :, 1]), 0.0)
    both = forward + backward
    p = 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -60, 60)))
    total = np.logaddexp(both[:, :1, 0], both[:, :1, 1])[:, :, None, None]
    pair = forward[:, :-1, :, None] + trans + (logit[:, 1:] + backward[:, 1:])[:, :, None, :] - total
    return p * inside, np.exp(np.minimum(pair, 0.0)) * inside[:, 1:, None, None]


@dataclass
class Chain:
    """Weights of the traits, of the first state and of the steps between states."""

    weight: np.ndarray
    start: np.ndarray
    trans: np.ndarray
    logistic: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    prior: float = 0.0

    def emissions(self) -> Callable[[list[bytes]], np.ndarray]:
        """Scores of a text's tokens, from a memory of each word's sums: its own, as left and as right neighbour."""
        known: dict[bytes, tuple[float, float, float]] = {}
        weight = self.weight.tolist()

        def of(words: list[bytes]) -> np.ndarray:
            new = set(words).difference(known)
            if len(known) + len(new) > MEMO_WORDS:
                known.clear()
                new = set(words)
            for w in new:
                t = traits(w)
                known[w] = sum(weight[i] for i in t[:OWN]), weight[t[OWN]], weight[t[OWN + 1]]
            x = np.array(list(map(known.__getitem__, words))).reshape(-1, 3)
            score = x[:, 0].copy()
            score[1:] += x[:-1, 1]
            score[:-1] += x[1:, 2]
            return score

        return of

    def tag(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Marginals of whole texts. A text is a row of chains of CHAIN words, all chains of all texts at once."""
        lengths = np.array([len(s) for s in scores], dtype=np.int64)
        flat = np.concatenate(scores) if len(scores) else np.zeros(0)
        if not len(flat):
            return [np.zeros(0) for _ in scores]
        ends = np.cumsum(lengths)
        chains = -(-lengths // CHAIN)
        first = np.repeat(ends - lengths, chains) + CHAIN * (np.arange(chains.sum()) - np.repeat(np.cumsum(chains) - chains, chains))
        size = np.minimum(CHAIN, np.repeat(ends, chains) - first)
        inside = np.arange(CHAIN) < size[:, None]
        padded = np.zeros(inside.shape)
        padded[inside] = flat
        p, _ = marginals(padded, size, self.start, self.trans)
        return np.split(p[inside], ends[:-1])

    def features(self, p: np.ndarray) -> list[float]:
        """What the document score is made from: the largest marginal, and the logarithm of the expected number of toxic tokens."""
        return [float(p.max()), float(np.log1p(p.sum()))] if len(p) else [0.0, 0.0]


def _telling(rows: list[set[int]], y: np.ndarray, evidence: float = 25.0, ratio: float = 8.0) -> set[int]:
    """Traits ``ratio`` times as frequent in toxic texts as in others, by a likelihood ratio statistic of at least ``evidence``."""
    counts = np.zeros((2, SLOTS))
    for r, k in zip(rows, y.astype(int), strict=True):
        counts[k, list(r)] += 1
    n = np.array([max(1.0, (y == k).sum()) for k in (0, 1)])
    total = counts.sum(axis=0)
    expected = total * (n / n.sum())[:, None]
    g = 2 * (counts * np.log(np.maximum(counts, 1e-9) / np.maximum(expected, 1e-9))).sum(axis=0)
    share = (counts[1] / n[1]) / ((counts[0] + 0.5) / n[0])
    return set(np.flatnonzero((g >= evidence) & (share >= ratio)).tolist())


def fit_chain(chains: list[np.ndarray], tags: list[np.ndarray], epochs: int = 30, rate: float = 0.3, ridge: float = 1e-5) -> Chain:
    """Gradient of the chains' log-likelihood with AdaGrad steps, over all chains at once."""
    width = max(map(len, chains))
    lengths = np.array([len(c) for c in chains])
    slots = np.zeros((len(chains), width, OWN + 2), np.int64)
    truth, inside = np.zeros((len(chains), width)), np.arange(width) < lengths[:, None]
    for i, (c, t) in enumerate(zip(chains, tags, strict=True)):
        slots[i, :len(c)], truth[i, :len(c)] = c, t
    pair_truth = np.stack([np.stack([((truth[:, :-1] == a) & (truth[:, 1:] == b) & inside[:, 1:]).sum() for b in (0, 1)]) for a in (0, 1)])
    weight, start, trans = np.zeros(SLOTS), np.zeros(2), np.zeros((2, 2))
    seen = [np.full(SLOTS, 1e-8), np.full(2, 1e-8), np.full((2, 2), 1e-8)]
    for _ in range(epochs):
        left, right = np.zeros(inside.shape), np.zeros(inside.shape)
        left[:, 1:] = weight[slots[:, :-1, OWN]] * inside[:, 1:]
        right[:, :-1] = weight[slots[:, 1:, OWN + 1]] * inside[:, 1:]
        emission = (weight[slots[:, :, :OWN]].sum(axis=2) + left + right) * inside
        p, pairs = marginals(emission, lengths, start, trans)
        off = (truth - p) * inside
        grad = np.zeros(SLOTS)
        for k in range(OWN):
            np.add.at(grad, slots[:, :, k][inside], off[inside])
        np.add.at(grad, slots[:, :-1, OWN][inside[:, 1:]], off[:, 1:][inside[:, 1:]])
        np.add.at(grad, slots[:, 1:, OWN + 1][inside[:, 1:]], off[:, :-1][inside[:, 1:]])
        grad -= ridge * len(chains) * weight
        g_start = np.array([(off[:, 0] * -1).sum(), off[:, 0].sum()])
        g_trans = pair_truth - pairs.sum(axis=(0, 1))
        for value, g, s in zip((weight, start, trans), (grad, g_start, g_trans), seen, strict=True):
            s += g * g
            value += rate * g / np.sqrt(s)
    return Chain(weight, start, trans)


def train(docs: DataFrame, marks: DataFrame, per_label: int = 1500, max_bytes: int = 16_384, text: str = "text", key: str = "doc_id") -> Chain:
    """Learn from at most ``per_label`` labelled rows of each label, held-out rows excluded.

    Two thirds of the sample find the telling traits and train the chain, one third calibrates the document score,
    weighted by the shares of the labels among all training labels. With labels of one kind only, every score is
    the share of toxic labels.
    """
    sample = labelled_sample(docs, marks, "toxic", per_label, max_bytes, text, key).toPandas().sort_values(["_order", "_text"])
    counts = {r["_label"]: r["count"] for r in label_of(marks, "toxic", key).filter(~held_out(key)).groupBy("_label").count().collect() if r["_label"] in (0, 1)}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    y = sample["_label"].to_numpy().astype(float)
    texts = [t.encode().split() for t in sample["_text"]]
    fits = np.arange(len(y)) % 3 < 2
    empty = Chain(np.zeros(SLOTS), np.zeros(2), np.zeros((2, 2)), None, prior)
    if not all(((y == k) & m).any() for k in (0, 1) for m in (fits, ~fits)):
        return empty
    known: dict[bytes, list[int]] = {}
    for words in texts:
        for w in words:
            if w not in known:
                known[w] = traits(w)
    at = np.flatnonzero(fits)
    telling = _telling([{t for w in set(texts[i]) for t in known[w][:OWN]} for i in at], y[at])
    marked = {w for w, t in known.items() if not telling.isdisjoint(t[:OWN])}
    chains, tags, plain = [], [], 0
    for i in at.tolist():
        for k in range(0, len(texts[i]), CHAIN):
            words = texts[i][k:k + CHAIN]
            hit = np.array([w in marked for w in words])
            plain += not hit.any()
            if hit.any() or plain % 8 == 0:
                chains.append(np.array([known[w] for w in words]))
                tags.append(hit * y[i])
    if not any(t.any() for t in tags):
        return empty
    model = fit_chain(chains, tags)
    held = np.flatnonzero(~fits)
    of = model.emissions()
    p = model.tag([of(texts[i]) for i in held])
    x, truth = np.array([model.features(q) for q in p]), y[held]
    weight = np.where(truth == 1, prior / truth.sum(), (1 - prior) / (1 - truth).sum()) * len(truth)
    model.logistic, model.prior = fit_logistic(x, truth, weight, 1e-3), prior
    return model


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """[start, end) in code points of the runs of words whose marginal is at least ``least``."""
    out: list[list[int]] = []
    last = -2
    for i, m in enumerate(WORD.finditer(text)):
        if p[i] >= least:
            if i == last + 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = i
    return [(a, b) for a, b in out]


def _scored(model: Chain) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = model.emissions()
        for batch in batches:
            for k in range(0, len(batch), TOGETHER):
                rows = batch.iloc[k:k + TOGETHER].copy()
                texts = rows.pop("_text").fillna("").tolist()
                p = model.tag([of(t.encode().split()) for t in texts])
                x = np.array([model.features(q) for q in p])
                score = np.full(len(x), model.prior) if model.logistic is None else apply_logistic(model.logistic, x)
                yield rows.assign(score=score, spans=[
                    [{"start": a, "end": b} for a, b in spans(t, q)] if len(q) and q.max() >= 0.5 else [] for t, q in zip(texts, p, strict=True)])

    return run


def score_toxicity(docs: DataFrame, model: Chain, cutoff: float = CUTOFF, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted, spans) of every whole text; spans are offsets in code points.

    Null texts are scored as empty and have no spans; null ids count as held out; repeated rows get equal results;
    other columns are not read; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text).alias("_text")).mapInPandas(
        _scored(model), f"`{key}` {kind}, held_out boolean, score double, spans array<struct<start:int,end:int>>")
    return scored.select(key, "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), "spans")
