"""Scans of a stream in event-time order, whatever order its rows arrive in.

Keys are dealt to buckets by hash, so that state is read and written once for many
keys. Rows wait in state, in one list per bucket and stretch of event time, until
the watermark has passed that stretch: nothing earlier can come any more. A timer
then releases them in order, each key through a machine whose own state is a few
numbers. So the result is that of the batch scan on the same rows, however they
were spread over files and batches. A task holds one stretch of one bucket at a
time (or several short ones), never a whole key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from queuelens.operators.machines import Cooldown, Hysteresis, Machine, State, TokenBucket
from queuelens.operators.ordered import breaker
from queuelens.streaming.jobs import use_rocksdb

class EwmaMachine:
    """v = alpha * x + (1 - alpha) * v, starting at the first value. State: v, or None before the first row."""

    fresh: State = None

    def __init__(self, alpha: float):
        self.alpha = alpha

    def run(self, columns: Sequence[np.ndarray], state: State) -> list[np.ndarray]:
        x = columns[0].astype(float)
        out = np.empty(len(x))
        for i, value in enumerate(x.tolist()):
            state = value if state is None else self.alpha * value + (1.0 - self.alpha) * state
            out[i] = state
        return [out]

    def summarise(self, columns: Sequence[np.ndarray]) -> tuple[float, float, float]:
        """What the values add to the end, the weight left to the state before, and the end without one."""
        x = columns[0].astype(float)
        weights = (1.0 - self.alpha) ** np.arange(len(x) - 1, -1, -1)
        return float(self.alpha * (weights * x).sum()), float((1.0 - self.alpha) ** len(x)), float(self.run(columns, None)[0][-1])

    def follow(self, summary: tuple[float, float, float], state: State) -> State:
        return summary[2] if state is None else summary[0] + summary[1] * state


class OrderedProcessor(StatefulProcessor):
    """Keeps a bucket's rows by stretch of event time until the watermark passes it, then runs each key's in order.

    ``arriving`` are the columns as they come, by their own names; ``gaps`` tells the flag of a whole-number column,
    which comes with 0 for null so that it stays whole. ``key`` is the key as text.
    """

    def __init__(self, arriving: Sequence[str], columns: Sequence[str], gaps: dict[str, str], key: str, us: str, order: Sequence[str],
                 inputs: Sequence[str], machine: Machine, outputs: Sequence[str], hold_us: int, chunk_rows: int) -> None:
        self.arriving, self.columns, self.gaps, self.key, self.us = list(arriving), list(columns), dict(gaps), key, us
        self.order, self.inputs, self.machine, self.outputs = list(order), list(inputs), machine, list(outputs)
        self.hold_us, self.chunk_rows = hold_us, chunk_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        packed, whole = StructType([StructField("packed", BinaryType())]), StructType([StructField("n", LongType())])
        self.waiting = handle.getMapState("waiting", StructType([StructField("stretch", LongType()), StructField("part", LongType())]), packed)
        self.parts = handle.getMapState("parts", StructType([StructField("stretch", LongType())]), whole)
        self.wakes = handle.getValueState("wakes", whole)
        self.machine_states = handle.getValueState("machines", packed)

    def _wake_at(self, stretch: int) -> None:
        """One timer a bucket: for the end of its earliest stretch."""
        self.handle.registerTimer((stretch + 1) * self.hold_us // 1000)
        self.wakes.update((stretch,))

    def _named(self, chunk: pd.DataFrame) -> pd.DataFrame:
        """Names with a leading _ do not arrive; nulls of whole numbers come back."""
        chunk = chunk.set_axis(self.arriving, axis=1)
        for name, flag in self.gaps.items():
            missing = chunk[flag].to_numpy(bool)
            if missing.any():
                chunk[name] = pd.arrays.IntegerArray(chunk[name].to_numpy(), missing)
        return chunk[list(dict.fromkeys([*self.columns, *self.inputs, self.us, self.key]))]

    def _keep(self, chunks: list[pd.DataFrame]) -> int:
        """Rows put to those of their stretches; the earliest stretch."""
        rows = pd.concat(chunks, ignore_index=True)
        stretch = rows[self.us].to_numpy() // self.hold_us
        line = np.argsort(stretch, kind="stable")
        rows, stretch = rows.iloc[line], stretch[line]
        starts = [*np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]]).tolist(), len(stretch)]
        for start, end in zip(starts, starts[1:]):
            at = int(stretch[start])
            n = self.parts.getValue((at,))[0] if self.parts.containsKey((at,)) else 0
            self.waiting.updateValue((at, n), (pickle.dumps(rows.iloc[start:end]),))
            self.parts.updateValue((at,), (n + 1,))
        return int(stretch[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, held, size = [], [], 0
        for chunk in rows:
            if not len(chunk):
                continue
            held.append(self._named(chunk))
            size += len(chunk)
            if size >= self.chunk_rows:
                first.append(self._keep(held))
                held, size = [], 0
        if held:
            first.append(self._keep(held))
        if first and (not self.wakes.exists() or min(first) < self.wakes.get()[0]):
            self._wake_at(min(first))
        return iter(())

    def _released(self, rows: pd.DataFrame, states: dict[str, State]) -> pd.DataFrame:
        """Each key's rows through the machine, from the key's state on."""
        code, keys = pd.factorize(rows[self.key])
        rows = rows.assign(**{self.key: code}).sort_values([self.key, *self.order], kind="stable", ignore_index=True)
        values, made = [rows[c].to_numpy() for c in self.inputs], []
        starts = np.searchsorted(rows[self.key].to_numpy(), np.arange(len(keys) + 1)).tolist()
        for name, start, end in zip(keys, starts, starts[1:]):
            state = states.get(name, self.machine.fresh)
            for low in range(start, end, self.chunk_rows):
                part = [v[low:min(low + self.chunk_rows, end)] for v in values]
                made.append(self.machine.run(part, state))
                state = self.machine.follow(self.machine.summarise(part), state)
            states[name] = state
        return rows[self.columns].assign(**{name: np.concatenate(parts) for name, parts in zip(self.outputs, zip(*made), strict=True)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // self.hold_us
        known = sorted(at for (at,) in self.parts.keys())
        due = [at for at in known if at < passed]
        states = pickle.loads(self.machine_states.get()[0]) if self.machine_states.exists() else {}
        held, size = [], 0
        for at in due:
            for i in range(self.parts.getValue((at,))[0]):
                held.append(pickle.loads(self.waiting.getValue((at, i))[0]))
                size += len(held[-1])
                self.waiting.removeKey((at, i))
            self.parts.removeKey((at,))
            if size >= self.chunk_rows or at == due[-1]:
                yield self._released(pd.concat(held, ignore_index=True), states)
                held, size = [], 0
        if due:
            self.machine_states.update((pickle.dumps(states),))
        if len(due) < len(known):
            self._wake_at(known[len(due)])
        else:
            self.wakes.clear()

    def close(self) -> None:
        pass


WHOLE = ("tinyint", "smallint", "int", "bigint")


def ordered_scan(stream: DataFrame, key: str, ts: str, tie: Sequence[str], machine: Machine, inputs: dict[str, Column],
                 outputs: dict[str, str], delay: str = "10 minutes", hold_seconds: int = 600, chunk_rows: int = 100_000,
                 buckets: int = 128) -> DataFrame:
    """``machine`` over each key of a stream in the order of ``(ts, *tie)``, which must tell all rows of a key apart.

    Rows come out when the watermark has passed their stretch of ``hold_seconds``; rows that arrive more than ``delay``
    late are dropped, as everywhere in event time, and the last stretches wait for rows that move the watermark on.
    Rows without a time or an input are left out. One task holds a stretch of a bucket, so a dense key wants short
    ones. A bucket's machine states, a few numbers a key, are rewritten together: many million keys want more
    ``buckets``, whose number must stay the same for a checkpoint.
    """
    use_rocksdb(stream.sparkSession)
    own = {name: f"_{name}" for name in ("us", "key", "bucket")}
    while set(own.values()) & set(stream.columns):
        own = {name: f"_{column}" for name, column in own.items()}
    us, text, bucket = own.values()
    named = {f"{us}_in{i}": c for i, c in enumerate(inputs.values())}
    gaps = {c: f"{us}_gap{i}" for i, (c, kind) in enumerate(stream.dtypes) if kind in WHOLE}
    made = stream.select("*", *[c.alias(n) for n, c in named.items()], F.unix_micros(ts).alias(us), F.to_json(F.struct(key)).alias(text),
                         *[F.col(c).isNull().alias(flag) for c, flag in gaps.items()])
    made = made.dropna(subset=[us, *named]).withWatermark(ts, delay).withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(kind) for c, kind in stream.dtypes if c in gaps})
    made = made.withColumn(bucket, F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int"))
    schema = ", ".join([*(f"`{n}` {t}" for n, t in stream.dtypes), *(f"`{n}` {t}" for n, t in outputs.items())])
    return made.groupBy(bucket).transformWithStateInPandas(
        OrderedProcessor(made.columns, stream.columns, gaps, text, us, [us, *tie], list(named), machine, list(outputs),
                         hold_seconds * 1_000_000, chunk_rows), schema, "append", "EventTime")


def stream_ewma(stream: DataFrame, key: str, ts: str, tie: Sequence[str], value: str, alpha: float = 0.3, **how) -> DataFrame:
    return ordered_scan(stream, key, ts, tie, EwmaMachine(alpha), {"x": F.col(value)}, {"ewma": "double"}, **how)


def stream_hysteresis(stream: DataFrame, key: str, ts: str, tie: Sequence[str], score: str, band: float = 0.15, **how) -> DataFrame:
    out = ordered_scan(stream, key, ts, tie, Hysteresis(band), {"x": F.col(score)}, {"kept_score": "double"}, **how)
    kept = F.col("kept_score")
    return out.withColumn("kept_action", F.when(kept > band, "scale_up").when(kept < -band, "scale_down").otherwise("steady"))


def stream_cooldown(stream: DataFrame, key: str, ts: str, tie: Sequence[str], seconds: float, **how) -> DataFrame:
    out = ordered_scan(stream, key, ts, tie, Cooldown(int(seconds * 1_000_000)), {"t": F.unix_micros(ts)}, {"_act": "boolean"}, **how)
    return out.filter("_act").drop("_act")


def stream_token_bucket(stream: DataFrame, key: str, ts: str, tie: Sequence[str], rate: float, capacity: float, **how) -> DataFrame:
    return ordered_scan(stream, key, ts, tie, TokenBucket(rate, capacity), {"t": F.unix_micros(ts)}, {"allowed": "boolean"}, **how)


def stream_breaker(stream: DataFrame, key: str, ts: str, tie: Sequence[str], variant: str = "streak", ok: str = "ok",
                   how: dict | None = None, **cfg) -> DataFrame:
    """The ``streak`` and ``window`` circuit breakers."""
    return ordered_scan(stream, key, ts, tie, breaker(variant, **cfg), {"t": F.unix_micros(ts), "ok": F.coalesce(F.col(ok), F.lit(False))},
                        {"state": "string", "allowed": "boolean"}, **(how or {}))
