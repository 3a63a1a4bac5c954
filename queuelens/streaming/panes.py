"""Trailing windows of several lengths over a stream, from one ring of panes per key.

Points are put into panes of one slide. A pane is a summary that can be joined
with others: count, sum, extremes, and at most ``points`` weighted values in
order. Whenever the watermark passes the end of a pane, the windows of every
length that end there are read from the panes they cover, and panes that no
later window needs are dropped. State is one ring per key, however many lengths
there are and however many points a pane has seen.

Quantiles: a pane of up to ``points`` values keeps them all. Beyond that it keeps
the middle value of each of ``points`` equal parts, which moves a rank by at most
``count / (2 * points)``; joining panes adds nothing to that, and a pane that is
cut again because more batches add to it, moves it by the same once more.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from queuelens.streaming.jobs import use_rocksdb

#: Values repeated over windows at one time.
SPREAD_AT_ONCE = 4_000_000
Pane = tuple[int, float, float, float, np.ndarray, np.ndarray]


def pane_of(values: np.ndarray) -> Pane:
    values = np.sort(values)
    return len(values), float(values.sum()), float(values[0]), float(values[-1]), values, np.ones(len(values), dtype=np.int64)


def joined(a: Pane, b: Pane) -> Pane:
    values, weights = np.concatenate([a[4], b[4]]), np.concatenate([a[5], b[5]])
    order = np.argsort(values, kind="stable")
    return a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3]), values[order], weights[order]


def thinned(pane: Pane, points: int) -> Pane:
    """The pane with at most ``points`` values: the middle one of each of so many equal parts."""
    n, total, low, high, values, weights = pane
    if len(values) <= points:
        return pane
    upto = np.cumsum(weights)
    edges = (np.arange(points + 1) * int(upto[-1])) // points
    middle = (edges[:-1] + edges[1:] + 1) // 2
    return n, total, low, high, values[np.searchsorted(upto, middle)], np.diff(edges)


def windows_of(panes: dict[int, Pane], length: int, first: int, last: int, quantiles: Sequence[float]) -> pd.DataFrame:
    """Statistics of all windows of ``length`` panes that end at a pane from ``first`` to ``last`` and hold a value."""
    numbers = np.array(sorted(panes))
    upto = np.concatenate([[0], np.cumsum([len(panes[p][4]) for p in numbers.tolist()])])
    ends = np.arange(first, last + 1)
    held = upto[np.searchsorted(numbers, ends, side="right")] - upto[np.searchsorted(numbers, ends - length + 1)]
    part = np.cumsum(held) // SPREAD_AT_ONCE  # as many ends together as keep the repeated values bounded
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(ends)]
    return pd.concat([_statistics(panes, numbers, length, int(ends[a]), int(ends[b - 1]), quantiles)
                      for a, b in zip(cuts, cuts[1:]) if b > a], ignore_index=True)


def _statistics(panes, numbers, length, first, last, quantiles) -> pd.DataFrame:
    used = numbers[(numbers > first - length) & (numbers <= last)].tolist()
    if not used:
        return pd.DataFrame({"end": [], "count": [], "sum": [], "min": [], "max": []})
    held = [panes[p] for p in used]
    ends = np.arange(first, last + 1)
    at = np.array(used)
    low, high = np.searchsorted(at, ends - length + 1), np.searchsorted(at, ends, side="right")
    full = high > low
    ends, low, high = ends[full], low[full], high[full]
    upto = lambda values: np.concatenate([[0], np.cumsum(values)])
    counts = upto([p[0] for p in held])
    cuts = np.stack([low, high], axis=1).ravel()
    bounds = lambda f, values: f.reduceat(np.append(values, values[-1]), cuts)[::2]
    out = pd.DataFrame({"end": ends, "count": counts[high] - counts[low], "sum": bounds(np.add, np.array([p[1] for p in held])),
                        "min": bounds(np.minimum, np.array([p[2] for p in held])), "max": bounds(np.maximum, np.array([p[3] for p in held]))})
    # every value once for each window that covers its pane, in the order of window and value
    values, weights = np.concatenate([p[4] for p in held]), np.concatenate([p[5] for p in held])
    pane = np.repeat(at, [len(p[4]) for p in held])
    order = np.argsort(values, kind="stable")
    values, weights, pane = values[order], weights[order], pane[order]
    begin, end = np.maximum(pane, first), np.minimum(pane + length - 1, last)
    times = np.maximum(end - begin + 1, 0)
    source = np.repeat(np.arange(len(values)), times)
    window = np.repeat(begin, times) + np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
    order = np.argsort(window, kind="stable")
    source, window = source[order], window[order]
    weight = np.cumsum(weights[source])
    before = np.concatenate([[0], weight])[np.searchsorted(window, ends)]
    for q in quantiles:
        rank = np.maximum(1, np.ceil(out["count"].to_numpy() * q - 1e-9)).astype(np.int64)
        out[f"p{round(q * 100)}"] = values[source[np.searchsorted(weight, before + rank)]]
    return out


class PaneRing(StatefulProcessor):
    """Panes of a key, kept in segments as long as the longest window, and one timer for the next end to report."""

    def __init__(self, keys: Sequence[str], lengths: Sequence[int], slide_us: int, points: int, quantiles: Sequence[float]) -> None:
        self.keys, self.lengths, self.slide_us, self.points, self.quantiles = list(keys), list(lengths), slide_us, points, list(quantiles)
        self.longest = max(lengths)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        number = StructType([StructField("number", LongType())])
        self.segments = handle.getMapState("segments", number, StructType([StructField("packed", BinaryType())]))
        self.next_end = handle.getValueState("next_end", number)

    def _wake_at(self, number: int) -> None:
        self.handle.registerTimer((number + 1) * self.slide_us // 1000)
        self.next_end.update((number,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for chunk in rows:
            chunk = chunk.set_axis([*self.keys, "ts", "us", "value"], axis=1)
            numbers, values = chunk["us"].to_numpy() // self.slide_us, chunk["value"].to_numpy(float)
            order = np.argsort(numbers, kind="stable")
            numbers, values = numbers[order], values[order]
            starts = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
            made = {int(numbers[a]): pane_of(values[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(numbers)])}
            for segment in sorted({n // self.longest for n in made}):
                held = pickle.loads(self.segments.getValue((segment,))[0]) if self.segments.containsKey((segment,)) else {}
                for n in [n for n in made if n // self.longest == segment]:
                    pane = made.pop(n)
                    held[n] = thinned(joined(held[n], pane) if n in held else pane, self.points)
                self.segments.updateValue((segment,), (pickle.dumps(held),))
            first = int(numbers[0]) if first is None else min(first, int(numbers[0]))
        if first is not None and (not self.next_end.exists() or first < self.next_end.get()[0]):
            self._wake_at(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // self.slide_us - 1
        if not self.next_end.exists() or self.next_end.get()[0] > passed:
            return
        first, held = self.next_end.get()[0], {k: pickle.loads(v[0]) for (k,), v in self.segments.iterator()}
        panes = {n: p for segment in held.values() for n, p in segment.items() if n <= passed}
        last = min(passed, max(panes) + self.longest - 1)
        for length in self.lengths:
            made = windows_of(panes, length, first, last, self.quantiles)
            if len(made):
                made.insert(0, "window_s", length * self.slide_us // 1_000_000)
                made["end"] = (made["end"].astype("int64") + 1) * self.slide_us
                for i, name in enumerate(self.keys):
                    made.insert(i, name, key[i])
                yield made
        ahead = []
        for segment, inside in held.items():
            left = {n: p for n, p in inside.items() if n > passed + 1 - self.longest}
            if not left:
                self.segments.removeKey((segment,))
            elif len(left) < len(inside):
                self.segments.updateValue((segment,), (pickle.dumps(left),))
            # the next end is the next pane's if an older pane still counts there, else that of the next pane with values
            ahead += [max(n, passed + 1) for n in left]
        if ahead:
            self._wake_at(min(ahead))
        else:
            self.next_end.clear()

    def close(self) -> None:
        pass


def stream_windows(stream: DataFrame, windows: Sequence[int] = (60, 300, 900, 3600), slide: int = 60, delay: str = "10 minutes",
                   by: Sequence[str] = ("name",), points: int = 256, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Statistics of each trailing window of ``windows`` seconds, refreshed every ``slide`` seconds, for each key.

    Columns: ``by``, ``window_s``, ``window_end``, ``count``, ``sum``, ``mean``, ``min``, ``max``, ``p50``, ``p95``. A window holds the
    points of ``[end - window, end)``; windows without points are not reported. Windows come out when the watermark
    passes their end; null, NaN and infinite values, and rows without a time, are left out.
    """
    if any(w % slide for w in windows):
        raise ValueError("every window must be a whole number of slides")
    use_rocksdb(stream.sparkSession)
    value = F.col("value").cast("double")
    rows = stream.filter(F.col("ts").isNotNull() & (F.abs(value) < float("inf"))).select(*by, "ts", F.unix_micros("ts").alias("us"), value.alias("value"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "window_s bigint, end bigint, count bigint, sum double, min double, max double",
                        *(f"p{round(q * 100)} double" for q in quantiles)])
    made = rows.withWatermark("ts", delay).groupBy(*by).transformWithStateInPandas(
        PaneRing(by, [w // slide for w in windows], slide * 1_000_000, points, quantiles), schema, "append", "EventTime")
    return made.select(*by, "window_s", F.timestamp_micros("end").alias("window_end"), "count", "sum", (F.col("sum") / F.col("count")).alias("mean"),
                       "min", "max", *[f"p{round(q * 100)}" for q in quantiles])
