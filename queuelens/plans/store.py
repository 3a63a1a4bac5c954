"""A store of fitted models with an index and a pointer to the active version of each type.

Three tables that are only ever appended to: the model files of a version, one
index row a version, written after its files, and one pointer row each time a
version becomes active. A reader takes the newest pointer whose version is in
the index, so a job that dies half way leaves the last state in force.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.operators.ordered import latest_per_key

INDEX = "model_type string, version string, path string, rmse double, n_test long, created_s long"
POINTER = "model_type string, version string, activated_s long, turn long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def model_index(spark: SparkSession, base: str) -> DataFrame:
    return _table(spark, f"{base}/index", INDEX)


def pointers(spark: SparkSession, base: str) -> DataFrame:
    """Every activation of a version that is in the index."""
    known = model_index(spark, base).select("model_type", "version")
    return _table(spark, f"{base}/pointer", POINTER).join(known, ["model_type", "version"], "left_semi")


def save_model(spark: SparkSession, base: str, model_type: str, version: str, model: PipelineModel, rmse: float, n_test: int, now_s: int) -> None:
    """Files first, then the index row. A version that a dead job left without a row is written anew."""
    if not model_index(spark, base).filter((F.col("model_type") == model_type) & (F.col("version") == version)).isEmpty():
        raise ValueError(f"version {version} of {model_type} exists")
    path = f"{base}/models/{model_type}/{version}"
    model.write().overwrite().save(path)
    spark.createDataFrame([(model_type, version, path, rmse, n_test, now_s)], INDEX).coalesce(1).write.mode("append").parquet(f"{base}/index")


def activate(spark: SparkSession, base: str, model_type: str, version: str, now_s: int) -> None:
    known = model_index(spark, base).filter((F.col("model_type") == model_type) & (F.col("version") == version))
    if known.isEmpty():
        raise ValueError(f"no version {version} of {model_type}")
    turn = pointers(spark, base).filter(F.col("model_type") == model_type).agg(F.max("turn")).first()[0] or 0
    spark.createDataFrame([(model_type, version, now_s, turn + 1)], POINTER).coalesce(1).write.mode("append").parquet(f"{base}/pointer")


def active(spark: SparkSession, base: str) -> DataFrame:
    """The version in force for each type, with its index row."""
    newest = latest_per_key(pointers(spark, base), "model_type", ["turn", "activated_s", "version"])
    return newest.join(model_index(spark, base), ["model_type", "version"])


def active_version(spark: SparkSession, base: str, model_type: str) -> str | None:
    row = active(spark, base).filter(F.col("model_type") == model_type).first()
    return row["version"] if row else None


def load_active(spark: SparkSession, base: str, model_type: str) -> PipelineModel | None:
    row = active(spark, base).filter(F.col("model_type") == model_type).first()
    return PipelineModel.load(row["path"]) if row else None


def last_run(spark: SparkSession, base: str, model_type: str) -> int | None:
    return model_index(spark, base).filter(F.col("model_type") == model_type).agg(F.max("created_s")).first()[0]


def rollback(spark: SparkSession, base: str, model_type: str, now_s: int) -> str | None:
    """Make the version active again that was in force before the present one; None where there was none."""
    mine = pointers(spark, base).filter(F.col("model_type") == model_type)
    now = active_version(spark, base, model_type)
    before = mine.filter(F.col("version") != F.lit(now)).orderBy(F.desc("turn")).first()
    if before is None:
        return None
    activate(spark, base, model_type, before["version"], now_s)
    return before["version"]
