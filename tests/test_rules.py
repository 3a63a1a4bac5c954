"""Row rules and aggregates on hand-made rows: the quirks and the edges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from queuelens.functions import columns as fc
from queuelens.operators import aggregates as ag
from queuelens.operators import experiments as ex
from queuelens.operators import lookups as lk
from queuelens.operators import ordered as od
from queuelens.operators import rows as rw
from queuelens.operators import select as sl
from queuelens.session import cut_lineage

AT = "2024-01-01 00:10:00"


def at(text=AT):
    return F.to_timestamp(F.lit(text))


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize("text,seconds", [("5m", 300), ("2h30m", 9000), ("1.5h", 5400), ("1d 4h 15m", 101700), ("3blips", 3), ("", 0), (None, 0), ("2 Weeks 1w", 604802)])
def test_parse_duration(spark, text, seconds):
    assert spark.createDataFrame([(text,)], "t string").select(fc.parse_duration("t")).first()[0] == seconds


@pytest.mark.parametrize("text,want", [("1704067200", "2024-01-01 00:00:00"), ("1704067200.5", "2024-01-01 00:00:00.5"), ("2024-01-01T00:00:00Z", "2024-01-01 00:00:00"),
                                       ("2024-01-01T02:00:00+02:00", "2024-01-01 00:00:00"), ("2024-01-01T00:00:00+00:00Z", None), ("soon", None), ("2024-01-01", "2024-01-01 00:00:00")])
def test_parse_instant(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(fc.parse_instant("t").cast("string")).first()[0]
    assert got == want


@pytest.mark.parametrize("text,want", [("secretkey", "secr*****"), ("sixsix", "******"), ("", ""), (None, None)])
def test_mask(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fc.mask("t")).first()[0] == want


def test_money(spark):
    df = spark.createDataFrame([(12.345,), (-0.05,), (0.0,)], "v double")
    assert [r[0] for r in df.select(fc.money_text(fc.to_cents("v"))).collect()] == ["12.35 USD", "-0.05 USD", "0.00 USD"]


def test_promotion(spark):
    runs = spark.createDataFrame([("a", 0.8, 1000), ("b", None, 1000), ("c", 0.8, 10), ("d", 0.5, 100)], "model string, rmse double, n_samples long")
    decide = lambda base, **kw: {r["model"]: (r["promote"], r["reason"]) for r in rw.promotion_decision(
        runs, spark.createDataFrame(base, "model string, rmse double"), "model", **kw).collect()}
    assert decide([], improve_abs=1.0)["a"] == (True, "absolute_threshold")
    assert decide([("a", 1.0)], improve_rel=0.05)["a"] == (True, "relative_improvement")
    got = decide([("a", 0.79)], improve_rel=0.1)
    assert got == {"a": (False, "insufficient_improvement"), "b": (False, "metric_missing"), "c": (False, "insufficient_samples"),
                   "d": (False, "no_promotion_condition_met")}


@pytest.mark.parametrize("new,want", [(1.05, False), (1.5, True)])
def test_regression_flag(spark, new, want):
    runs = spark.createDataFrame([("a", new, 100)], "model string, rmse double, n_samples long")
    base = spark.createDataFrame([("a", 1.0)], "model string, rmse double")
    assert rw.promotion_decision(runs, base, "model").first()["regressed"] is want


def test_rule_and_fused_scores(spark):
    df = spark.createDataFrame([(1000.0, 1.5, 0.8), (50.0, 0.7, 0.35), (500.0, 1.0, 0.5)], "backlog double, latency double, cpu double")
    assert [round(r[0], 6) for r in df.select(fc.rule_score()).collect()] == [2.0, -2.0, 0.0]
    f = spark.createDataFrame([(2.0, None, None), (1.0, 1.0, None), (None, None, None)], "a double, b double, c double")
    assert [round(r[0], 6) for r in f.select(fc.fuse_scores("a", "b", "c")).collect()] == [2.0, 1.0, 0.0]


def test_window_snapshot_slots(spark):
    pts = spark.createDataFrame([("m", float(i), f"2024-01-01 00:09:{i:02d}.5") for i in range(5)] + [("m", 99.0, "2024-01-01 00:10:00.9"), ("m", 7.0, "2024-01-01 00:10:01")],
                                "name string, value double, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = one(ag.window_snapshot(pts, [60], at()))
    # the slot of 00:09:00 is 60 slots back and out; the slot of as_of is in
    assert (got["count"], got["min"], got["max"], got["p50"], got["p95"]) == (5, 1.0, 99.0, 3.0, 4.0)
    assert ag.window_snapshot(pts.limit(0), [60], at()).count() == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "value double")
    bins = {r["bin"]: r["count"] for r in ag.histogram(df, "value", 50).collect()}
    assert bins[49] == 3 and sum(bins.values()) == 101
    same = spark.createDataFrame([(4.0,)] * 3, "value double")
    assert [tuple(r) for r in ag.histogram(same, "value", 50).collect()] == [(0, 3)]
    assert ag.histogram(same.limit(0)).count() == 0


def test_failure_rate_without_acks(spark):
    hist = spark.createDataFrame([("fail",)], "event string").withColumn("ts", at())
    assert one(ag.failure_rate(hist, 1, at())) == {"failures": 1, "acks": 0, "failure_pct": 0.0, "failure_share_pct": 100.0}


def test_health_order(spark):
    rows = [("a", 1, "ok"), ("a", 2, "warn"), ("a", 3, "fail"), ("b", 1, "fail"), ("b", 2, "warn"), ("c", 1, "ok")]
    got = {r["g"]: r["overall"] for r in ag.health_rollup(spark.createDataFrame(rows, "g string, pos int, status string"), ["g"]).collect()}
    assert got == {"a": "degraded", "b": "fail", "c": "ok"}


def test_drift_edges(spark):
    ref = spark.createDataFrame([(1.0, "x"), (1.0, None)], "v double, c string")
    new = spark.createDataFrame([(3.0, "x"), (3.0, "y")], "v double, c string")
    assert ag.numeric_drift(ref, new, ["v"]).first()["score"] == 2.0  # tiny deviation counts as 1
    assert ag.numeric_drift(ref, new.limit(1), ["v"]).first()["score"] == 0.0
    assert ag.categorical_drift(ref, ref, ["c"]).first()["score"] == pytest.approx(0.0, abs=1e-9)
    assert 0.2 < ag.categorical_drift(ref, new, ["c"]).first()["score"] < 0.7
    got = one(ag.dataset_drift(ref, new))
    assert got["flagged"] == "c,v" and got["ref_rows"] == 2


def test_latency_bucket_formula(spark):
    for n in (2, 3, 7, 40):
        df = spark.createDataFrame([(i, float((i * 7) % n)) for i in range(n)], "id long, v double")
        got = {r["id"]: r["bucket"] for r in od.latency_bucket(df, "v", "id").collect()}
        order = sorted(range(n), key=lambda i: ((i * 7) % n, i))
        want = {i: max(-(-(r * 5) // (n - 1)) - 1, 0) for r, i in enumerate(order)}
        assert got == want


def test_split_sizes(spark):
    df = spark.range(103).withColumnRenamed("id", "i")
    parts = {r["part"]: r["count"] for r in sl.split_rows(df, (8, 1, 1), 3, "i").groupBy("part").count().collect()}
    assert parts == {"train": 82, "val": 10, "test": 11}
    again = sl.split_rows(df, (8, 1, 1), 3, "i")
    assert again.exceptAll(sl.split_rows(df.repartition(5), (8, 1, 1), 3, "i")).count() == 0


@pytest.mark.parametrize("edges,acyclic", [([("a", "b"), ("b", "c")], True), ([("a", "b"), ("b", "a")], False), ([("a", "a")], False), ([], True),
                                           ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], True), ([("a", "b"), ("b", "c"), ("c", "b")], False)])
def test_dag_check(spark, edges, acyclic):
    nodes = spark.createDataFrame([("w", n) for n in "abcd"], "workflow string, node_id string")
    links = spark.createDataFrame([("w", a, b) for a, b in edges], "workflow string, src string, dst string")
    got = one(lk.dag_check(nodes, links))
    assert got["acyclic"] is acyclic and got["nodes"] == 4 and got["edges"] == len(edges)
    assert got["start_nodes"] == 4 - len({b for _, b in edges}) and got["end_nodes"] == 4 - len({a for a, _ in edges})


def test_encode_keeps_first_appearance(spark):
    df = spark.createDataFrame([(3, "b"), (1, "z"), (2, None), (4, "z"), (5, "a")], "i long, c string")
    out, maps = rw.encode_categoricals(df, ["c"], "i")
    assert {r["i"]: r["c"] for r in out.collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 3}
    assert {r["value"]: r["code"] for r in maps["c"].collect()} == {"z": 0, "": 1, "b": 2, "a": 3}


def test_keep_last_n_beyond_the_group_limit(spark):
    rows = [(i, i % 2, i // 3) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, key long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"] for r in od.keep_last_n(df, 1300, ["ts", "id"], ["key"]).collect()}
    want = {r[0] for k in (0, 1) for r in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))[-1300:]}
    assert got == want
    overall = {r["id"] for r in od.keep_last_n(df, 1300, ["ts", "id"]).collect()}
    assert overall == set(range(3700, 5000))
    assert od.keep_last_n(df, 9999, ["ts", "id"]).count() == 5000


def test_basic_clean_without_time(spark):
    df = spark.createDataFrame([("True", "12.7"), ("x", None)], "success string, duration_ms string")
    got = [r.asDict() for r in rw.basic_clean(df, "when", at()).collect()]
    assert [(r["success"], r["duration_ms"], r["priority"], r["consumer_count"]) for r in got] == [(1, 12, 0, 1), (0, 0, 0, 1)]
    assert all(r["ts"] is not None for r in got)


def test_ab_compare_known_values(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, 5.0)] + [("b", v) for v in (2.0, 4.0, 6.0, 8.0, 10.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, arm string, x double")
    got = one(ex.ab_compare(df, "arm", "x", "id", draws=200))
    assert got["t"] == pytest.approx(1.897367) and got["p_value"] == pytest.approx(0.0943498, abs=1e-6)
    assert got["u_b"] == 20.0 and got["recommendation"] == "inconclusive"
    assert got["ci_low"] < 3.0 < got["ci_high"] and got["improvement_pct"] == pytest.approx(100.0)
    wide = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("arm"),
                                    (F.col("id") % 10 + F.when(F.col("id") % 2 == 0, 0).otherwise(2)).cast("double").alias("x"))
    assert ex.ab_compare(wide, "arm", "x", "id", "mannwhitneyu", draws=100).first()["recommendation"] == "deploy"
    assert ex.ab_compare(df.filter("arm = 'a'"), "arm", "x", "id", draws=20).first()["recommendation"] == "insufficient_data"


def rounds_of(spark, monkeypatch, links):
    """(cyclic workflows, rounds): each round writes three tables."""
    written = []
    monkeypatch.setattr(lk, "cut_lineage", lambda df: (written.append(1), cut_lineage(df))[1])
    found = {r["workflow"] for r in lk.cyclic_workflows(spark.createDataFrame(links, "workflow long, src long, dst long")).collect()}
    return found, len(written) // 3


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    chain = [(1, i, i + 1) for i in range(4096)]
    ring = [(2, i, (i + 1) % 1000) for i in range(1000)]
    late = [(3, i, i + 1) for i in range(500)] + [(3, 500, 480)]
    found, rounds = rounds_of(spark, monkeypatch, chain + ring + late + [(4, 7, 7), (5, 1, 2)])
    assert found == {2, 3, 4} and rounds <= 15


@pytest.mark.parametrize("seed", range(3))
def test_cycles_of_random_graphs(spark, monkeypatch, seed):
    import random
    draw, links, want = random.Random(seed), set(), set()
    for w in range(60):
        n = draw.randrange(2, 12)
        mine = {(draw.randrange(n), draw.randrange(n)) for _ in range(draw.randrange(1, 2 * n))}
        if w % 2:
            mine = {(min(a, b), max(a, b)) for a, b in mine if a != b}
        links |= {(w, a, b) for a, b in mine}
        reach = set(mine)
        while (more := reach | {(a, d) for a, b in reach for c, d in mine if b == c}) != reach:
            reach = more
        if any(a == b for a, b in reach):
            want.add(w)
    found, _ = rounds_of(spark, monkeypatch, sorted(links))
    assert found == want and 0 < len(want) < 40
