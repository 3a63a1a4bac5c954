"""Sliced frames and order statistics against plain Python, with a hot key."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from queuelens.operators import orderstats
from queuelens.operators.orderstats import boundary_rows, linear_percentiles, order_stats, position
from queuelens.operators.slices import cut_lists, deviation, global_position, key_of, micros, prefix_frame, row_frame, sliced, sweep_frame


def rows_with_hot_key(n: int = 900, seed: int = 5):
    """A third of the rows under one key; repeated instants and long gaps."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(40)}"
        second = rnd.choice([rnd.randrange(300), rnd.randrange(5000), 77])
        out.append((i, key, second, rnd.randrange(-50, 50)))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    rows = rows_with_hot_key()
    return rows, spark.createDataFrame(rows, "id long, key string, s long, x long").withColumn("ts", F.timestamp_seconds("s")).cache()


def grouped(rows, by_key=True):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1] if by_key else None, []).append(r)
    return groups


@pytest.mark.parametrize("rows_of_a_slice", [1, 10, 100, 10**6])
@pytest.mark.parametrize("before,after", [(4, 0), (0, 3), (2, 2)])
def test_row_frame(frame, rows_of_a_slice, before, after):
    rows, df = frame
    out = row_frame(df, ["key"], ["ts", "id"], lambda w: {
        "total": F.sum("x").over(w.rowsBetween(-before, after)), "n": F.count("x").over(w.rowsBetween(-before, after))}, before, after, rows_of_a_slice)
    got = {r["id"]: (r["total"], r["n"]) for r in out.collect()}
    want = {}
    for g in grouped(rows).values():
        for i, r in enumerate(g):
            part = [y[3] for y in g[max(0, i - before):i + after + 1]]
            want[r[0]] = (sum(part), len(part))
    assert got == want


def test_row_frame_without_key(frame):
    rows, df = frame
    out = row_frame(df, [], ["ts", "id"], lambda w: {"next": F.lead("id").over(w)}, after=1, slice_rows=50)
    order = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert {r["id"]: r["next"] for r in out.collect()} == dict(zip(order, [*order[1:], None]))


@pytest.mark.parametrize("rows_of_a_slice", [10, 1000])
def test_prefix_frame(frame, rows_of_a_slice):
    rows, df = frame
    out = prefix_frame(df, ["key"], ["ts", "id"], {"run": F.col("x")}, slice_rows=rows_of_a_slice)
    want = {}
    for g in grouped(rows).values():
        total = 0
        for r in g:
            total += r[3]
            want[r[0]] = total
    assert {r["id"]: r["run"] for r in out.collect()} == want


@pytest.mark.parametrize("rows_of_a_slice", [5, 50, 10**6])
def test_sweep_frame(frame, rows_of_a_slice):
    rows, df = frame
    out = sweep_frame(df, ["key"], "ts", {"a": (60_000_000, 0), "b": (30_000_000, -1)}, {"x": F.col("x")}, {"q": F.col("x")}, rows_of_a_slice)
    out = out.withColumn("std", deviation(F.col("a_n"), F.col("a_x"), F.col("a_q"), False))
    got = {r["id"]: (r["a_n"], r["a_x"], r["b_n"], int(r["b_q"]), r["std"]) for r in out.collect()}
    assert len(got) == len(rows)
    for g in grouped(rows).values():
        for r in g:
            a = [y[3] for y in g if r[2] - 60 <= y[2] <= r[2]]
            b = [y[3] for y in g if r[2] - 30 <= y[2] < r[2]]
            n, x, m, q, std = got[r[0]]
            assert (n, x, m, q) == (len(a), sum(a), len(b), sum(v * v for v in b))
            assert std == pytest.approx(statistics.pstdev(a), abs=1e-9)


def test_global_position(spark):
    ids = random.Random(1).sample(range(-10**6, 10**12), 500)
    df = spark.createDataFrame([(i,) for i in ids], "v long")
    got = {r["v"]: r["p"] for r in global_position(df, "v", "p", 16).collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(ids))}
    assert {r["v"]: r["p"] for r in global_position(df, "v", "p", 16, within=(-10**6, 10**12)).collect()} == got


VALUES = {
    "wide": lambda r: r.choice([0.0, -1.5, 3.25, r.gauss(0, 1), r.gauss(0, 1e-6), r.gauss(1e12, 1), -r.random() * 1e15]),
    "narrow": lambda r: 1_700_000_000.0 + r.randrange(2000) / 1000,
    "equal": lambda r: 4.0,
    "powers": lambda r: 2.0 ** r.randrange(-30, 30) * r.choice([1, -1]),
}


@pytest.mark.parametrize("kind", list(VALUES))
def test_order_stats(spark, kind):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", VALUES[kind](rnd)) for i in range(700)]
    df = spark.createDataFrame(rows, "key string, v double")
    out = order_stats(df, ["key"], "v", {"lo": position(0.0), "p50": position(0.5, -1), "p95": position(0.95), "hi": position(1.0)})
    got = {r["key"]: tuple(r)[1:] for r in out.collect()}
    for key in {k for k, _ in rows}:
        vals = sorted(v for k, v in rows if k == key)
        n = len(vals)
        assert got[key] == (vals[0], vals[int(0.5 * (n - 1))], vals[min(n - 1, int(0.95 * n))], vals[-1])


def test_order_stats_edges(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "key string, v double")
    assert [tuple(r) for r in order_stats(df, ["key"], "v", {"m": position(0.5)}).collect()] == [("b", 2.0)]
    assert order_stats(df.filter("key = 'z'"), [], "v", {"m": position(0.5)}).first()["m"] is None


def test_linear_percentiles(spark):
    vals = [random.Random(9).gauss(10, 4) for _ in range(257)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = linear_percentiles(df, [], "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95}).first()
    cuts = statistics.quantiles(vals, n=20, method="inclusive")
    assert got["p5"] == pytest.approx(cuts[0]) and got["p50"] == pytest.approx(cuts[9]) and got["p95"] == pytest.approx(cuts[18])


def test_boundary_rows_with_one_hot_value(spark):
    rows = [(i, 5.0 if i % 3 else float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, v double")
    picks = {f"c{p}": (lambda n, p=p: F.lit(p)) for p in (0, 150, 300, 599)}
    order = sorted((v, i) for i, v in rows)
    assert boundary_rows(df, "v", "id", picks) == {f"c{p}": order[p] for p in (0, 150, 300, 599)}


def test_cuts_follow_the_rows(spark):
    """A burst of 90 % of the rows of a key is cut finely, quiet stretches and small keys are not cut at all."""
    draw = random.Random(6)
    rows = [("hot", 600_000 + draw.randrange(6000)) for _ in range(9000)] + [("hot", draw.randrange(2_000_000)) for _ in range(1000)]
    rows += [(None, i) for i in range(900)] + [("small", i) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out, cut = sliced(df, ["key"], micros("ts"), 500)
    assert cut and not sliced(df, ["key"], micros("ts"), 10**6)[1]
    sizes = {(r["key"], r["_slice"]): (r["n"], r["a"], r["b"]) for r in out.groupBy("key", "_slice").agg(
        F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b")).collect()}
    hot = [v for (k, _), v in sorted(sizes.items(), key=str) if k == "hot"]
    assert len(hot) >= 15 and max(n for n, _, _ in hot) < 900
    hot.sort(key=lambda v: v[1])
    assert all(a[2] < b[1] for a, b in zip(hot, hot[1:]))  # slices follow each other
    assert [v[0] for (k, _), v in sizes.items() if k == "small"] == [50]
    assert sum(v[0] for (k, _), v in sizes.items() if k is None) == 900 and sum(k is None for k, _ in sizes) == 2
    lists = cut_lists(df.select(key_of(["key"]).alias("_key"), micros("ts").alias("_at")), 500)
    assert lists.count() == 2  # nothing is listed for the small key


def test_rows_without_a_time_are_in_no_frame(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "a", 6)], "id long, key string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = sweep_frame(df, ["key"], "ts", {"w": (10_000_000, 0)}, {})
    assert {r["id"]: r["w_n"] for r in out.collect()} == {1: 1, 2: 0, 3: 2}


def test_a_frame_may_be_longer_than_any_slice(spark):
    df = spark.range(500).withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    out = sweep_frame(df, [], "ts", {"w": (400 * 60_000_000, 0)}, {"x": F.col("id")}, None, 10)
    assert {r["id"]: (r["w_n"], r["w_x"]) for r in out.collect()} == {i: (min(i, 400) + 1, sum(range(max(0, i - 400), i + 1))) for i in range(500)}


@pytest.mark.parametrize("kind", [*VALUES, "hot"])
def test_boundary_rows_narrow_down(spark, monkeypatch, kind):
    """Brackets too large to list are narrowed by further sketches, down to single values and their ties."""
    monkeypatch.setattr(orderstats, "SMALL", 30)
    monkeypatch.setattr(orderstats, "GRID", 16)
    monkeypatch.setattr(orderstats, "SKETCH_ITEMS", 64)
    draw = random.Random(kind)
    made = VALUES.get(kind, lambda r: r.choice([7.0, 7.0, 7.0, 8.0, r.random()]))
    rows = [(i, made(draw)) for i in draw.sample(range(10**6), 3000)]
    df = spark.createDataFrame([*rows, (10**7, None), (10**7 + 1, float("nan")), (10**7 + 2, float("nan"))], "id long, v double")
    order = sorted((v, i) for i, v in rows)
    places = (0, 1, 700, 1499, 1500, 2998, 2999)
    picks = {f"c{p}": (lambda n, p=p: F.lit(p)) for p in places}
    got = boundary_rows(df, "v", "id", {**picks, "nan": lambda n: n - 1, "past": lambda n: n})
    assert {k: got[k] for k in picks} == {f"c{p}": order[p] for p in places}
    assert got["nan"][1] == 10**7 + 2 and got["nan"][0] != got["nan"][0] and got["past"] is None
    assert boundary_rows(df.filter("id < 0"), "v", "id", picks) == dict.fromkeys(picks)


def test_bounds_of_a_missed_bracket(spark):
    """A grid that lies leads to the values beside its bracket, never to a wrong row."""
    rows = spark.range(50_000).select(F.col("id").cast("double").alias("_v"), F.col("id").alias("_t"))
    for lie in ([float(i) for i in range(orderstats.GRID + 1)], [49_000.0] * (orderstats.GRID + 1)):
        got = orderstats.select_rows(rows, {"a": 5, "b": 25_000, "c": 49_999}, 50_000, grid=lie)
        assert got == {"a": (5.0, 5), "b": (25_000.0, 25_000), "c": (49_999.0, 49_999)}
