"""Streams against the batch operators on the same rows, over several micro-batches."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens import fixtures as fx
from queuelens.operators import ordered as od
from queuelens.session import scratch_path
from queuelens.sources import sinks
from queuelens.streaming import jobs, ordered_state, panes


@pytest.fixture(scope="module")
def chunks(spark, data):
    """Events in time order as four files, one per micro-batch."""
    ev = fx.table(spark, data, "events").drop("props")
    path = scratch_path(spark, "chunks")
    day = F.dayofmonth("ts")
    for low in (0, 8, 16, 24):  # one after the other: files are taken in the order they were written
        ev.filter((day >= low) & (day < low + 8)).coalesce(1).write.mode("append").parquet(path)
    return ev, lambda: spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)


def mixed_up(spark, ev, files):
    """Rows dealt to files by time with up to two days of delay, one file a trigger."""
    path = scratch_path(spark, "mixed")
    delayed = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(2 * 86_400)) - F.unix_seconds(F.to_timestamp(F.lit("2024-01-01")))
    for low in range(files):
        ev.filter(F.floor(delayed * files / (33 * 86_400)) == low).repartition(1, "event_id").write.mode("append").parquet(path)
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("kind", ["window", "ewma"])
@pytest.mark.parametrize("files,hold,chunk", [(1, 86_400, 7), (9, 7200, 100_000)])
def test_ordered_scan_equals_batch(spark, data, kind, files, hold, chunk):
    ev = fx.table(spark, data, "events").select("event_id", "user_id", "event_type", "ts", "value").withColumns(
        {"target": F.col("user_id") % 3, "ok": F.col("event_type") != "error"})
    live, how = mixed_up(spark, ev, files), {"delay": "2 days", "hold_seconds": hold, "chunk_rows": chunk}
    if kind == "window":
        out = ordered_state.stream_breaker(live, "target", "ts", ["event_id"], "window", how=how, threshold=3, window_s=86400)
        want = od.circuit_breaker(ev, ["target"], ["ts", "event_id"], "window", threshold=3, window_s=86400)
        row = lambda r: (r["state"], r["allowed"])
    else:
        out = ordered_state.stream_ewma(live, "target", "ts", ["event_id"], "value", **how)
        want = od.ewma(ev, ["target"], ["ts", "event_id"], "value")
        row = lambda r: round(r["ewma"], 9)
    top = ev.agg(F.max(F.unix_micros("ts"))).first()[0] - 2 * 86_400_000_000
    end = (F.floor(F.unix_micros("ts") / (hold * 1_000_000)) + 1) * hold * 1_000_000
    got = jobs.run_to_table(out, "scan").collect()
    want = {r["event_id"]: row(r) for r in want.filter(end <= top).collect()}
    assert len(got) == len(want) > 700 and {r["event_id"]: row(r) for r in got} == want


def test_many_keys_share_state(spark):
    """Null keys, null ids and ids beyond 2^53 keep their values; state is counted by buckets, not by keys."""
    n = F.col("id")
    rows = spark.range(6000).select(
        F.when(n % 3001 != 0, n % 3001 + 2**60).alias("key"), F.when(n != 5, n + 2**53).alias("event_id"),
        F.when(n % 4 != 0, n.cast("int")).alias("small"), (F.pmod(F.xxhash64(n), F.lit(1000)) / 8).alias("value"),
        F.timestamp_seconds(F.pmod(F.xxhash64(n, F.lit(1)), F.lit(100_000))).alias("ts"))
    path, checkpoint = scratch_path(spark, "rows"), scratch_path(spark, "cp")
    for low in range(2):
        rows.filter(F.floor(F.unix_seconds("ts") / 50_000) == low).repartition(1).write.mode("append").parquet(path)
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = ordered_state.stream_ewma(live, "key", "ts", ["event_id"], "value", delay="1000 seconds", hold_seconds=7200)
    got = jobs.run_to_table(out, "keys", checkpoint=checkpoint).collect()
    top = (rows.agg(F.max(F.unix_seconds("ts"))).first()[0] - 1000) // 7200 * 7200
    want = od.ewma(rows, ["key"], ["ts", "event_id"], "value").filter(F.unix_seconds("ts") < top).collect()
    plain = lambda found: sorted(tuple("" if v is None else str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in found)
    assert plain(got) == plain(want) and len(got) > 5000
    assert 0 < spark.read.format("statestore").option("stateVarName", "wakes").load(checkpoint).count() <= 128


def test_windows_over_batches(spark, data):
    """Out of order rows over nine triggers, two keys, windows of four lengths against plain Python."""
    ev = fx.table(spark, data, "events").select("event_id", (F.col("user_id") % 2).alias("name"), "value", "ts")
    out = panes.stream_windows(mixed_up(spark, ev, 9), (3600, 7200, 86_400), 3600, "2 days")
    got = {(r["name"], r["window_s"], r["window_end"].timestamp()): tuple(r)[3:] for r in jobs.run_to_table(out, "windows").collect()}
    rows = [(r["name"], r["ts"].timestamp(), r["value"]) for r in ev.collect()]
    top, held = max(t for _, t, _ in rows) - 2 * 86_400, {}
    for name, t, value in rows:
        for w in (3600, 7200, 86_400):
            for i in range(w // 3600):
                end = (t // 3600 + 1 + i) * 3600
                if end <= top:
                    held.setdefault((name, w, end), []).append(value)
    assert got.keys() == held.keys() and len(got) > 1000
    for k, values in held.items():
        values.sort()
        n = len(values)
        count, total, mean, low, high, p50, p95 = got[k]
        assert (count, low, high, p50, p95) == (n, values[0], values[-1], values[-(-n // 2) - 1], values[-(-95 * n // 100) - 1])
        assert total == pytest.approx(sum(values)) and mean == pytest.approx(sum(values) / n)


def test_thinned_panes_keep_ranks():
    draw = np.random.default_rng(1)
    held, panes_of = [], {}
    for number in range(40):
        values = draw.choice([draw.lognormal(0, 1, 5000), np.full(5000, 3.0), draw.normal(50, 1, 5000)])
        panes_of[number] = panes.thinned(panes.pane_of(values), 100)
        held.append(values)
    assert all(len(p[4]) <= 100 and p[5].sum() == p[0] == 5000 for p in panes_of.values())
    out = panes.windows_of(panes_of, 7, 3, 45, [0.5, 0.95])
    assert out["end"].tolist() == list(range(3, 46))
    for r in out.itertuples():
        values = np.sort(np.concatenate(held[max(0, int(r.end) - 6):int(r.end) + 1]))
        assert r.count == len(values) and r.sum == pytest.approx(values.sum()) and (r.min, r.max) == (values[0], values[-1])
        for q, found in ((0.5, r.p50), (0.95, r.p95)):
            low, high = np.searchsorted(values, found), np.searchsorted(values, found, side="right")
            assert low - len(values) / 200 - 40 <= q * len(values) <= high + len(values) / 200 + 40
    twice = panes.thinned(panes.joined(panes_of[0], panes_of[1]), 100)
    assert len(twice[4]) <= 100 and twice[0] == twice[5].sum() == 10_000


def test_late_rows_counts(spark):
    base = scratch_path(spark, "src")
    for i, seconds in enumerate([[100, 200], [150, 90], [500, 10]]):
        spark.createDataFrame([(s,) for s in seconds], "s long").select(F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{base}/b={i}")
    stream = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(base)
    out = scratch_path(spark, "late")
    jobs.late_rows(stream, 60, out, scratch_path(spark, "cp"))
    got = [(r["rows"], r["late"]) for r in spark.read.parquet(f"{out}/late/*").orderBy("batch_id").collect()]
    assert got == [(2, 0), (2, 1), (2, 1)]


def test_dedup_and_tables(spark, chunks):
    ev, stream = chunks
    got = jobs.run_to_table(jobs.stream_dedup(stream().unionAll(stream()), "event_id"), "dedup")
    assert got.count() == ev.count()
    base = scratch_path(spark, "tables")
    sinks.stream_to_tables(stream(), base, "event_type", scratch_path(spark, "cp")).awaitTermination()
    assert spark.read.parquet(base).count() == ev.count()


def test_replay_leaves_the_rest(spark):
    dlq = spark.createDataFrame([(i, f"q{i % 2}", i) for i in range(10)], "task_id long, queue_key string, s long").select(
        "task_id", "queue_key", F.timestamp_seconds("s").alias("ts"), F.lit("e").alias("error"))
    backlog = spark.createDataFrame([("q0", 5), ("q1", 500)], "queue_key string, backlog long")
    go, stay = jobs.dlq_replay(dlq, backlog, F.timestamp_seconds(F.lit(126)), 2, 120, 100)
    assert {r["task_id"] for r in go.collect()} == {0, 2}
    assert {r["task_id"] for r in stay.collect()} == set(range(10)) - {0, 2}
    none, _ = jobs.dlq_replay(dlq, backlog, F.timestamp_seconds(F.lit(126)), 2, 120, 100, hint=0.9)
    assert none.count() == 0


def test_topic_message_shape(spark):
    df = spark.createDataFrame([(1, "a", 2.5)], "id long, name string, v double")
    got = sinks.topic_message(df, "id", {"origin": "test"}).first()
    assert got["key"] == "1" and got["value"] == '{"name":"a","v":2.5}' and got["headers"][0]["key"] == "origin"
