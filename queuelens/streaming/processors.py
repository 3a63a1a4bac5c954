"""Stateful processors: timers per key."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from queuelens.streaming.jobs import use_rocksdb


class DeadlineProcessor(StatefulProcessor):
    """Reports a key when an arming event is not followed in time.

    State is the pending deadline in microseconds; a timer wakes the key when
    the watermark passes it.
    """

    def __init__(self, key: str, arm: Sequence[str], seconds: int) -> None:
        self.key, self.arm, self.span = key, set(arm), int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", StructType([StructField("at", StringType())]))

    def _get(self):
        return int(self.pending.get()[0]) if self.pending.exists() else None

    def _frame(self, key, deadlines):
        return pd.DataFrame({self.key: [key[0]] * len(deadlines), "deadline_us": deadlines})

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values("us", kind="stable")
        deadline, missed = self._get(), []
        for event, us in zip(batch["event"].tolist(), batch["us"].tolist()):
            if deadline is not None and us > deadline:
                missed.append(deadline)
                deadline = None
            deadline = us + self.span if event in self.arm else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if deadline is None:
            self.pending.clear()
        else:
            self.pending.update((str(deadline),))
            self.handle.registerTimer(-(-deadline // 1000))
        if missed:
            yield self._frame(key, missed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        deadline = self._get()
        if deadline is not None:
            self.pending.clear()
            yield self._frame(key, [deadline])

    def close(self) -> None:
        pass


def stream_deadlines(stream: DataFrame, key: str, arm: Sequence[str], seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Keys whose arming event had no successor within ``seconds`` of event time.

    Serves the visibility timeout (a reserved task without an ack) and worker
    liveness (a heartbeat without the next one). Needs ``event`` and ``ts``.
    """
    use_rocksdb(stream.sparkSession)
    timed = stream.select(key, "event", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", delay)
    kind = dict(stream.dtypes)[key]
    return timed.groupBy(key).transformWithStateInPandas(
        DeadlineProcessor(key, arm, seconds), f"{key} {kind}, deadline_us bigint", "append", "EventTime")
