"""From raw documents to encoded training text, in five stages of whole-corpus Spark jobs.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelens.llm import bpe, linedup, mixing, neardup, quality
from queuelens.llm.common import documents, labels, unused
from queuelens.session import scratch_path

KEY = "doc_id"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    Null texts are scored as empty ones, texts of any length whole, a block at a time; equal texts share their fate,
    and repeated rows stay for the later stage that removes them. Columns may have any names. No rows give no rows.
    """
    return quality.keep_good(docs, quality.train(docs, labels(spark, sf_dir)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines shared by many sites.

    Null texts stay null and empty ones empty; a null source is a site of its own. No row is dropped or added.
    """
    return linedup.remove_shared_lines(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the smallest id.

    Of rows that repeat an id the one of the smallest text stays (null first). Rows without an id are compared with
    none but their equals: one of each text stays. Null and empty texts are alike to nothing.
    """
    kept_id, times, place = (unused(docs, name) for name in ("kept_id", "times", "place"))
    kept = neardup.near_duplicates(docs).filter("kept").select(F.col(KEY).alias(kept_id)).distinct()
    single = docs.join(kept, F.col(KEY).eqNullSafe(F.col(kept_id)), "left_semi")
    # ids that occur once need no further look; texts of the others are put in order
    repeated = docs.groupBy(F.col(KEY).alias(kept_id)).agg(F.count(F.lit(1)).alias(times)).filter(F.col(times) > 1).select(kept_id)
    same = F.col(KEY).eqNullSafe(F.col(kept_id))
    order = Window.partitionBy(KEY, F.when(F.col(KEY).isNull(), F.col("text"))).orderBy(F.col("text").asc_nulls_first())
    first = single.join(repeated, same, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return single.join(repeated, same, "left_anti").unionByName(first)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Ids are meant to be unique here, as the stage before leaves them; rows that share one (or have none) get the
    number of copies of the first of them. A null source is a source; texts without words are taken once.
    """
    mixed_id, copies, copy = (unused(docs, name) for name in ("mixed_id", "copies", "copy"))
    mixed = (mixing.mix_sources(docs).groupBy(F.col(KEY).alias(mixed_id)).agg(F.min("copies").cast("int").alias(copies)).filter(F.col(copies) > 0))
    return docs.join(mixed, F.col(KEY).eqNullSafe(F.col(mixed_id))).withColumn(
        copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to.

    Null and empty texts have no ids; each copy of a document gives a row; other columns are not read.
    """
    return bpe.encode_decode(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage),
          ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: Learnt dictionaries and tokenizers are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = scratch_path(spark, f"corpus-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
