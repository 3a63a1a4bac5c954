"""Model jobs: they run, score every row and explain what drives the target."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from queuelens.plans import models, store
from queuelens.session import scratch_path
from queuelens.sources.sinks import list_versions


@pytest.fixture(scope="module")
def trained(spark):
    h = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000
    df = spark.range(3000).select("id", h(1).alias("a"), h(2).alias("b")).withColumn("y", F.col("a") * 10 + 0.1 * F.col("b"))
    made = models.train_predictor(df, ["a", "b"], "y", ["id"], rounds=30, maxDepth=4)
    return df, made.model, made


def test_metrics(trained):
    m = trained[2].metrics.first()
    assert m["n"] > 400 and 0 <= m["rmse"] < 1.0 and m["p95_abs_err"] >= 0 and m["r2"] > 0.9


def test_effects(trained):
    df, model, _ = trained
    got = {r["feature"]: r for r in models.feature_effects(df, model, ["a", "b"], "y", "id").collect()}
    assert got["a"]["importance"] > 0.9 and got["a"]["rmse_rise"] > 1.0 > abs(got["b"]["rmse_rise"])


def test_effects_read_the_input_once(trained):
    df, model, _ = trained
    plan = models.feature_effects(df, model, ["a", "b"], "y", "id")._jdf.queryExecution().toString()
    assert "Range (" not in plan and "Scan parquet" in plan


def test_scoring_keeps_every_row(trained):
    df, model, _ = trained
    gaps = df.withColumn("a", F.when(F.col("id") % 10 != 0, F.col("a")))
    got = models.batch_score(gaps, model, ["a", "b"], "v7", ["id"], lambda c: c / 10)
    assert got.count() == 3000
    assert got.filter("error = 'missing_feature' and prediction is null").count() == 300
    assert {r["hint"] for r in got.select("hint").distinct().collect()} == {"scale_up", "scale_down", "steady", None}


def test_training_stops_where_validation_rows_gain_no_more(spark, trained):
    curve = trained[2].curve
    assert 1 < len(curve) < 30 and curve[-1] < curve[0]
    noise = spark.range(2000).select("id", F.rand(1).alias("a"), F.rand(2).alias("y"))
    assert len(models.train_predictor(noise, ["a"], "y", ["id"], rounds=30, maxDepth=3).curve) < 6
    uses = {r["_use"]: r["count"] for r in trained[2].matrix.groupBy("_use").count().collect()}
    assert set(uses) == {"train", "valid", "test"} and sum(uses.values()) == 3000 and 450 < uses["test"] < 750 and 150 < uses["valid"] < 330


def test_parts_are_those_of_any_md5(spark):
    import hashlib
    got = {r["id"]: r["p"] for r in spark.range(50).select("id", models.portable_part(["id"], 7).alias("p")).collect()}
    assert got == {i: int(hashlib.md5(f"{i}|42".encode()).hexdigest()[:8], 16) % 7 for i in range(50)}


def test_search_tries_all_points_on_the_same_folds(spark, trained):
    df = trained[0]
    ranked, folds = models.search_params(df, ["a", "b"], "y", ["id"], {"maxDepth": [1, 4], "numTrees": [2, 3]}, folds=3)
    rows = ranked.collect()
    assert len(rows) == 4 and "('maxDepth', 4)" in rows[0]["params"] and rows[0]["rmse"] < rows[-1]["rmse"]
    sizes = {r["fold"]: r["n"] for r in folds.collect()}
    assert set(sizes) == {0, 1, 2} and sum(sizes.values()) == 3000
    assert len(models.draw_grid({"x": [1, 2, 3], "y": [1, 2]}, 4)) == 4


def test_search_fits_each_point_once_a_fold(spark, trained, monkeypatch):
    """Errors are those of Spark's own cross-validation on the same folds; no fit is made whose model nobody gets."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator
    df = trained[0].filter("id < 600")
    pipe = models.make_pipeline(["a", "b"], "y", "forest", numTrees=2)
    maps = [{pipe.getStages()[-1].getParam("maxDepth"): depth} for depth in (1, 3)]
    plain = CrossValidator(estimator=pipe, estimatorParamMaps=maps, numFolds=2, foldCol="_fold", evaluator=RegressionEvaluator(labelCol="y")).fit(
        df.select("a", "b", "y", models.portable_part(["id"], 2).alias("_fold")))
    fits, fit = [], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, rows: fits.append(1) or fit(self, rows))
    ranked, _ = models.search_params(df, ["a", "b"], "y", ["id"], {"maxDepth": [1, 3]}, folds=2, numTrees=2)
    got = {r["params"]: (r["rmse"], r["rmse_std"]) for r in ranked.collect()}
    assert len(fits) == 4
    for depth, mean, std in zip((1, 3), plain.avgMetrics, plain.stdMetrics):
        assert got[f"[('maxDepth', {depth})]"] == pytest.approx((mean, std), rel=0.05)
    with pytest.raises(ValueError, match="no rows in fold"):
        models.search_params(df.filter("id < 1").unionAll(df.filter("id < 1")), ["a", "b"], "y", ["id"], {"maxDepth": [1]}, folds=2)


def test_search_reads_small_parts_of_its_folds_as_vectors(spark, trained, monkeypatch):
    """Every scan of a fit was a new assembly of all folds' rows, in parts as large as the session's files may be."""
    from pyspark.ml.regression import RandomForestRegressor
    from tests.test_plans import plan
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    monkeypatch.setattr(models, "FIT_ROWS", 100, raising=False)
    seen, before, fit = [], [spark.conf.get(n) for n in names], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, rows: seen.append((plan(rows), rows.count(), rows.rdd.getNumPartitions())) or fit(self, rows))
    for df, least, most in ((trained[0].coalesce(1), 4, 20), (trained[0].repartition(60), 1, 30)):
        seen.clear()
        _, folds = models.search_params(df, ["a", "b"], "y", ["id"], {"maxDepth": [1, 2]}, folds=3, numTrees=2)
        sizes = {r["fold"]: r["n"] for r in folds.collect()}
        assert sorted(n for _, n, _ in seen) == sorted(2 * [3000 - n for n in sizes.values()])
        for text, _, parts in seen:
            assert "UDF(" not in text and "PartitionFilters: [isnotnull(_fold" in text
            assert least <= parts <= most
    assert [spark.conf.get(n) for n in names] == before


def test_search_fits_one_point_at_a_time_where_it_fills_the_cores(spark, trained, monkeypatch):
    import threading
    import time
    from pyspark.ml.regression import RandomForestRegressor
    lock, now, most, fit = threading.Lock(), [0], [0], RandomForestRegressor._fit

    def counted(self, rows):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.5)
        try:
            return fit(self, rows)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(RandomForestRegressor, "_fit", counted)
    search = lambda: models.search_params(trained[0].filter("id < 600"), ["a", "b"], "y", ["id"], {"maxDepth": [1, 2]}, folds=2, numTrees=2)[0].count()
    assert search() == 2 and most == [2]
    monkeypatch.setattr(models, "FIT_ROWS", 600 // spark.sparkContext.defaultParallelism, raising=False)
    most[0] = 0
    assert search() == 2 and most == [1]


RUN = {"now_s": 100_000, "params": {"rounds": 3, "maxDepth": 3}}


@pytest.fixture(scope="module")
def stored(spark, trained):
    """A store with an active first version."""
    base = scratch_path(spark, "store")
    row = models.retrain_job(spark, base, "m", "v1", trained[0], trained[0], ["a", "b"], "y", ["id"], RUN).first()
    assert (row["status"], row["reason"], row["active"]) == ("promoted", "first_version", "v1") and row["n_test"] > 400
    return base


@pytest.mark.parametrize("cfg,status,reason", [
    ({"now_s": 100_100}, "cooldown", None), ({"now_s": 200_000, "min_drift": 9.0}, "no_drift", None),
    ({"now_s": 300_000, "canary_limit": 1e-9}, "rejected", "canary_failed"), ({"now_s": 400_000, "improve_rel": 2.0}, "rejected", "insufficient_improvement"),
    ({"now_s": 500_000, "min_samples": 10**9}, "rejected", "insufficient_samples")])
def test_retrain_outcomes(spark, trained, stored, cfg, status, reason):
    df = trained[0]
    new = df.withColumn("y", F.col("y") + 5)
    version = f"try-{status}-{reason}"
    row = models.retrain_job(spark, stored, "m", version, df, new, ["a", "b"], "y", ["id"], RUN | cfg).first()
    assert (row["status"], row["reason"], row["active"]) == (status, reason, "v1")
    assert (row["rmse"] is None) == (status != "rejected") and (row["base_rmse"] or 0) >= 0


def test_versions_are_promoted_and_rolled_back(spark, trained):
    df, base = trained[0], scratch_path(spark, "store")
    new = df.withColumn("y", F.col("y") + 5)
    run = lambda v, now, rows: models.retrain_job(spark, base, "m", v, df, rows, ["a", "b"], "y", ["id"], RUN | {"now_s": now}).first()
    assert run("v1", 10_000, df)["active"] == "v1"
    second = run("v2", 20_000, new)
    assert (second["status"], second["reason"], second["active"]) == ("promoted", "relative_improvement", "v2") and second["rmse"] < second["base_rmse"]
    loaded = store.load_active(spark, base, "m")
    assert loaded.transform(new).filter("abs(prediction - y) < 2").count() > 2500
    assert list_versions(spark, f"{base}/training").count() == 2
    assert store.rollback(spark, base, "m", 30_000) == "v1" and store.active_version(spark, base, "m") == "v1"
    assert store.rollback(spark, base, "m", 40_000) == "v2"
    with pytest.raises(ValueError):
        store.save_model(spark, base, "m", "v1", loaded, 1.0, 1, 1)
    with pytest.raises(ValueError):
        store.activate(spark, base, "m", "v9", 1)


def test_files_without_an_index_row_are_no_version(spark, trained):
    """What a job leaves that died between its files and their index row."""
    base = scratch_path(spark, "store")
    assert store.active_version(spark, base, "m") is None and store.rollback(spark, base, "m", 1) is None
    trained[1].write().overwrite().save(f"{base}/models/m/v1")
    spark.createDataFrame([("m", "v1", 5, 1)], store.POINTER).write.parquet(f"{base}/pointer")
    assert store.active_version(spark, base, "m") is None and store.load_active(spark, base, "m") is None
    store.save_model(spark, base, "m", "v1", trained[1], 0.5, 10, 7)
    assert store.active_version(spark, base, "m") == "v1"
