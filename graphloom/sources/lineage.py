"""Cutting the lineage of iterative plans through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which ``spark.checkpoint.dir`` names; a local one is set only where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def whole_sum(x: Column) -> Column:
    """The sum of a long as a decimal, which 64 bits need not hold; see :func:`as_longs`."""
    return F.sum(x.cast("decimal(20,0)"))


def as_longs(df: DataFrame, column: str) -> DataFrame:
    """A few rows of sums with ``column`` as a long where each of them fits; else it stays a decimal, since no sum may be lost. The rows are worked out once."""
    df = cut(df)
    lowest, highest = df.agg(F.min(column), F.max(column)).first()
    return df.withColumn(column, F.col(column).cast("long")) if lowest is None or (lowest >= -(1 << 63) and highest < 1 << 63) else df
