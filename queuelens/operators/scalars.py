"""One-row tables beside other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table on every row.

    A scalar subquery: it runs once, no join is planned, and Spark raises an
    error should the table have more than one row.
    """
    packed = row.select(F.struct(*row.columns).alias("_packed")).scalar()
    return df.withColumn("_one", packed).select(*df.columns, *[F.col("_one")[c].alias(c) for c in row.columns])
