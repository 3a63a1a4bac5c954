"""State machines and recurrences against a plain loop, for several slice widths."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens.operators import ordered as od
from queuelens.operators import machines as mc
from tests.loops import bucket_step, cooldown_step, hysteresis_step, share_breaker_step, streak_breaker_step, window_breaker_step

#: Rows of a slice: many slices, and one.
ROWS = [20, 10**6]


@pytest.fixture(scope="module")
def reqs(spark):
    rnd = random.Random(11)
    rows, t = [], 0
    for i in range(500):
        t += rnd.choice([0, 1, 2, 5, 90])
        rows.append((i, "hot" if i % 3 == 0 else f"k{i % 5}", t, rnd.random() < 0.6, rnd.uniform(-3, 3)))
    df = spark.createDataFrame(rows, "id long, key string, s long, ok boolean, score double").withColumn("ts", F.timestamp_seconds("s")).cache()
    return rows, df


def loop(rows, step, fresh, pick):
    states, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        state, made = step(states.get(r[1], list(fresh)), pick(r))
        states[r[1]] = state
        out[r[0]] = made
    return out


@pytest.mark.parametrize("rows_of_a_slice", ROWS)
def test_cooldown(reqs, rows_of_a_slice):
    rows, df = reqs
    last, want = {}, set()
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if r[1] not in last or r[2] - last[r[1]] >= 30:
            last[r[1]] = r[2]
            want.add(r[0])
    got = od.cooldown_filter(df, ["key"], ["ts", "id"], 30, slice_rows=rows_of_a_slice)
    assert {r["id"] for r in got.collect()} == want


@pytest.mark.parametrize("rows_of_a_slice", ROWS)
def test_token_bucket(reqs, rows_of_a_slice):
    rows, df = reqs
    tokens, seen, want = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        have = min(4.0, tokens.get(r[1], 4.0) + (r[2] - seen.get(r[1], r[2])) * 0.05)
        want[r[0]] = have >= 1.0
        tokens[r[1]], seen[r[1]] = have - 1.0 if have >= 1.0 else have, r[2]
    got = od.token_bucket(df, ["key"], ["ts", "id"], 0.05, 4.0, slice_rows=rows_of_a_slice)
    assert {r["id"]: r["allowed"] for r in got.collect()} == want


@pytest.mark.parametrize("rows_of_a_slice", ROWS)
@pytest.mark.parametrize("variant,cfg", [("window", {"threshold": 3, "window_s": 60}), ("streak", {"trip": 2, "open_s": 20, "successes": 2})])
def test_breakers(reqs, rows_of_a_slice, variant, cfg):
    rows, df = reqs
    step, fresh = (window_breaker_step(3, 60_000_000) if variant == "window" else streak_breaker_step(2, 20_000_000, 2))
    want = loop(rows, step, fresh, lambda r: (r[2] * 1_000_000, r[3]))
    got = od.circuit_breaker(df, ["key"], ["ts", "id"], variant, slice_rows=rows_of_a_slice, **cfg)
    assert {r["id"]: (r["state"], r["allowed"]) for r in got.collect()} == want
    assert len({s for s, _ in want.values()}) > 1


def test_share_breaker(reqs):
    rows, df = reqs
    step, fresh = share_breaker_step(3, 60_000_000, 0.3, 2)

    def pick(r):
        near = [q for q in rows if q[1] == r[1] and r[2] - 60 < q[2] <= r[2]]
        return r[2] * 1_000_000, r[3], sum(not q[3] for q in near), sum(q[3] for q in near)
    want = loop(rows, step, fresh, pick)
    got = od.circuit_breaker(df, ["key"], ["ts", "id"], "share", slice_rows=20, threshold=3, window_s=60, share=0.3, recover=2)
    assert {r["id"]: (r["state"], r["allowed"]) for r in got.collect()} == want


@pytest.mark.parametrize("rows_of_a_slice", ROWS)
def test_hysteresis_and_ewma(reqs, rows_of_a_slice):
    rows, df = reqs
    kept, mean, want = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        old = kept.get(r[1], 0.0)
        kept[r[1]] = max(min(old if abs(r[4] - old) < 0.15 else r[4], 2.0), -2.0)
        mean[r[1]] = r[4] if r[1] not in mean else 0.3 * r[4] + 0.7 * mean[r[1]]
        want[r[0]] = (kept[r[1]], mean[r[1]])
    h = od.hysteresis(df, ["key"], ["ts", "id"], "score", slice_rows=rows_of_a_slice)
    assert {r["id"]: r["kept_score"] for r in h.collect()} == {i: k for i, (k, _) in want.items()}
    e = {r["id"]: r["ewma"] for r in od.ewma(df, ["key"], ["ts", "id"], "score", slice_rows=rows_of_a_slice).collect()}
    assert e.keys() == want.keys()
    for i, (_, m) in want.items():
        assert e[i] == pytest.approx(m, abs=1e-9)


@pytest.mark.parametrize("rows_of_a_slice", [2, 1000])
def test_gae(spark, rows_of_a_slice):
    rnd = random.Random(2)
    rows = [(e, t, rnd.random(), rnd.random(), t == 6 and e % 2 == 0) for e in range(4) for t in range(9 + e)]
    df = spark.createDataFrame(rows, "e long, t long, reward double, value double, done boolean")
    want = {}
    for e in range(4):
        steps = [r for r in rows if r[0] == e]
        adv = 0.0
        for i in reversed(range(len(steps))):
            _, t, reward, value, done = steps[i]
            nxt = steps[i + 1][3] if i + 1 < len(steps) else 0.0
            adv = reward + 0.9 * nxt * (not done) - value + 0.9 * 0.8 * (not done) * adv
            want[(e, t)] = adv
    got = od.gae(df, "e", ["t"], 0.9, 0.8, slice_rows=rows_of_a_slice).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["advantage"] == pytest.approx(want[(r["e"], r["t"])])
        assert r["returns"] == pytest.approx(want[(r["e"], r["t"])] + r["value"])


# --- machines as functions of their entry state ---------------------------

def made_rows(draw, n, gaps):
    t, share, rows = 0, draw.random(), []
    for _ in range(n):
        t += draw.choice(gaps)
        rows.append((t, draw.random() < share, draw.uniform(-3, 3) * draw.choice([1, 0.2])))
    return (np.array([r[i] for r in rows]) for i in range(3))


def machine_and_loop(kind, draw, t, ok, x):
    """(machine, its columns, the same as a row by row loop, fresh state)."""
    wait = draw.choice([1, 3, 10, 50])
    if kind == "cooldown":
        return mc.Cooldown(wait), [t], *cooldown_step(wait)
    if kind == "hysteresis":
        band = draw.choice([0.01, 0.15, 0.5, 1.0])
        return mc.Hysteresis(band), [x], *hysteresis_step(band)
    if kind == "bucket":
        rate, room = draw.choice([1000, 3333, 50_000, 7e5, 1e6]), draw.choice([0.5, 1, 2, 4.5, 10])
        return mc.TokenBucket(rate, room), [t], *bucket_step(rate, room)
    if kind == "streak":
        how = draw.choice([1, 2, 3, 5]), wait, draw.choice([1, 2, 3])
        return mc.StreakBreaker(*how), [t, ok], *streak_breaker_step(*how)
    if kind == "window":
        how = draw.choice([1, 2, 3, 5]), wait
        return mc.WindowBreaker(*how), [t, ok], *window_breaker_step(*how)
    near = lambda i, wanted: int(((t <= t[i]) & (t > t[i] - wait) & (ok == wanted)).sum())
    seen = [np.array([near(i, wanted) for i in range(len(t))]) for wanted in (False, True)]
    how = draw.choice([1, 2, 4]), wait, draw.choice([0.3, 0.5, 0.7]), draw.choice([1, 2, 5])
    return mc.ShareBreaker(*how), [t, ok, *seen], *share_breaker_step(*how)


@pytest.mark.parametrize("kind", ["cooldown", "hysteresis", "bucket", "streak", "window", "share"])
def test_a_machine_in_slices_equals_the_loop(kind):
    draw = random.Random(kind)
    for _ in range(150):
        n = draw.choice([1, 2, 5, 30, 120])
        t, ok, x = made_rows(draw, n, draw.choice([[0, 1, 2, 5, 90], [0, 1, 1, 2], [50, 100, 3], [1]]))
        machine, columns, step, fresh = machine_and_loop(kind, draw, t + 1, ok, x)
        state, want = list(fresh), []
        for row in zip(*[c.tolist() for c in columns]):
            state, made = step(state, row)
            want.append(made)
        cuts = sorted({0, n, *(draw.randrange(n) for _ in range(draw.choice([0, 1, 3, 10, n])))})
        state, got = machine.fresh, []
        for a, b in zip(cuts, cuts[1:]):
            part = [c[a:b] for c in columns]
            got += zip(*[o.tolist() for o in machine.run(part, state)])
            state = machine.follow(machine.summarise(part), state)
        assert got == want


def test_summaries_stay_small():
    """A slice of many rows is described by a few numbers, once ways through it meet."""
    draw = np.random.default_rng(4)
    t = np.cumsum(draw.integers(0, 2_000_000, 50_000))
    ok, x = draw.random(50_000) < 0.6, draw.normal(0, 1, 50_000)
    assert len(mc.Cooldown(60_000_000).summarise([t])[0]) < 50
    assert len(mc.TokenBucket(0.7, 5).summarise([t])) < 20
    records = mc.Hysteresis(0.3).summarise([x])
    assert len(records[0]) + len(records[3]) < 60
    assert len(mc.StreakBreaker().summarise([t, ok])[3]) < 80 and len(mc.WindowBreaker(5, 300_000_000).summarise([t, ok])["upto"]) < 200


@pytest.mark.parametrize("rows_of_a_slice", [7, 10**6])
def test_null_keys_are_a_key(spark, rows_of_a_slice):
    rows = [(i, None if i % 2 else "a", 10 * i, float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, key string, s long, x double").withColumn("ts", F.timestamp_seconds("s"))
    acts = {r["id"] for r in od.cooldown_filter(df, ["key"], ["ts", "id"], 100, slice_rows=rows_of_a_slice).collect()}
    assert acts == {*range(0, 60, 10), *range(1, 60, 10)}
    mean = {r["id"]: r["ewma"] for r in od.ewma(df, ["key"], ["ts", "id"], "x", slice_rows=rows_of_a_slice).collect()}
    assert len(mean) == 60 and mean[1] == 1.0 and mean[3] == pytest.approx(0.7 * 1 + 0.3 * 3)
    near = od.moving_average(df, ["key"], ["ts", "id"], "x", 2, slice_rows=rows_of_a_slice)
    assert {r["id"]: r["moving_avg"] for r in near.collect()} == {i: (x + rows[i - 2][3]) / 2 if i > 1 else x for i, _, _, x in rows}
    swept = od.rate_limit_flags(df, ["key"], 2, 45, slice_rows=rows_of_a_slice)
    assert {r["id"]: r["in_window"] for r in swept.collect()} == {i: min(3, i // 2 + 1) for i in range(60)}
