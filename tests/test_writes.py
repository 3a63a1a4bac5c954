"""Keyed tables, retention by folders, manifests and paging."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from queuelens.session import scratch_path
from queuelens.sources import keyed, scan

SCHEMA = "k long, v string, t long"


def table(spark, name, parts=16):
    return keyed.KeyedTable(spark, scratch_path(spark, name), spark.createDataFrame([], SCHEMA).schema, ["k"], parts)


def rows(spark, made):
    return spark.createDataFrame(made, SCHEMA)


def held(t):
    return {r["k"]: (r["v"], r["t"]) for r in t.read().collect()}


def written(t):
    """Modification times of the partitions' files."""
    path = t.path.removeprefix("file:")
    return {p: sorted(os.stat(f"{path}/{p}/{f}").st_mtime_ns for f in os.listdir(f"{path}/{p}") if f.endswith(".parquet"))
            for p in os.listdir(path) if p.startswith("part=")}


def test_upsert_keeps_the_newest_and_repeats_change_nothing(spark):
    t = table(spark, "upsert")
    assert held(t) == {} and t.upsert(rows(spark, [(i, "a", 5) for i in range(100)] + [(None, "n", 1)]), "b1", "t")
    changes = rows(spark, [(1, "new", 6), (2, "old", 4), (3, "equal", 5), (200, "more", 1), (None, "m", 2), (4, "x", None)])
    assert t.upsert(changes, "b2", "t")
    want = {**{i: ("a", 5) for i in range(100)}, 1: ("new", 6), 3: ("equal", 5), 200: ("more", 1), None: ("m", 2)}
    assert held(t) == want
    before = written(t)
    assert not t.upsert(changes, "b2", "t") and written(t) == before
    assert held(t) == want


def test_a_batch_rewrites_only_its_partitions(spark):
    t = table(spark, "touched")
    t.upsert(rows(spark, [(i, "a", 1) for i in range(2000)]), "b1", "t")
    before = written(t)
    assert len(before) == 16
    t.upsert(rows(spark, [(7, "b", 2)]), "b2", "t")
    after = written(t)
    assert sum(before[p] != after[p] for p in before) == 1 and t.read().count() == 2000
    t.upsert(rows(spark, []), "b3", "t")
    assert written(t) == after and not t.upsert(rows(spark, [(1, "z", 9)]), "b3", "t")


def test_a_batch_that_died_is_done_again(spark):
    """Swapped in but without its ledger entry: the replay gives the same rows."""
    t = table(spark, "replay")
    t.append_new(rows(spark, [(i, "a", i) for i in range(50)]), "b1", "t", 99)
    fresh = rows(spark, [(40, "late", 1), (60, "two", 7), (60, "one", 6), (61, "none", None)])
    t.append_new(fresh, "b2", "t", 99)
    want = {**{i: ("a", i) for i in range(50)}, 60: ("one", 6), 61: ("none", 99)}
    assert held(t) == want
    fs, at = keyed._files(spark, f"{t.path}/_ledger/batch=b2")
    fs.delete(at, True)
    assert t.append_new(fresh, "b2", "t", 99) and held(t) == want and t.read().count() == 52


def test_old_days_are_dropped_without_reading(spark):
    base = scratch_path(spark, "retention")
    df = spark.range(90).select("id", F.date_add(F.to_date(F.lit("2024-01-01")), F.col("id").cast("int")).alias("day"))
    for name in ("scaling_summary", "drift_events"):
        df.write.partitionBy("day").parquet(f"{base}/{name}")
    # a folder of an old day whose rows cannot be read is deleted all the same
    got = {r["table"]: tuple(r)[1:] for r in keyed.trim_all(spark, base, "2024-03-30").collect()}
    assert got == {"scaling_summary": (82, 82, 8, 8), "drift_events": (0, 0, 90, 90)}
    assert spark.read.parquet(f"{base}/scaling_summary").agg(F.min("id")).first()[0] == 82
    again = keyed.trim_days(spark, f"{base}/scaling_summary", 7, "2024-03-30").first()
    assert tuple(again) == (0, 0, 8, 8)
    assert tuple(keyed.trim_days(spark, f"{base}/nothing", 7, "2024-03-30").first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("in_a_row", [0, 1000, 10**6])
def test_manifest_has_one_rule_for_all_sizes(spark, tmp_path, in_a_row):
    files = {"empty": b"", "small": b"abc", "block": bytes(64), "odd name ü%": os.urandom(1000), "sub/large": os.urandom(5001)}
    (tmp_path / "sub").mkdir()
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: (r["size"], r["digest"]) for r in scan.file_manifest(spark, str(tmp_path), 64, in_a_row).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((len(c), sha("".join(sha(c[i:i + 64]) for i in range(0, len(c), 64)).encode())) for c in files.values() if c)
    assert sorted(got.values()) == want and len(got) == 4


def test_pages_follow_each_other_through_equal_times(spark):
    df = spark.createDataFrame([(i, 10 * (i // 7)) for i in range(40)], "id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    token, seen = None, []
    while True:
        page = scan.page_by_ts(df, token, 6)
        token = scan.next_token(page)
        if token is None:
            break
        seen.append([r["id"] for r in page.collect()])
    assert [i for p in seen for i in p] == [r["id"] for r in df.orderBy(F.desc("ts"), "id").collect()] and len(seen) == 7
