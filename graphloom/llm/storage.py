"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one is chosen only where the setting is absent."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = f"file://{tempfile.gettempdir()}/graphloom_checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: At the end of a write, nothing reads its shuffle files any more; Spark leaves them to its garbage collector by default.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that a lost executor costs no recomputation. Its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def materialize_buckets(df: DataFrame, keys: list[str], name: str = "t") -> DataFrame:
    """:func:`materialize`, as a table bucketed by ``keys``: joins on just those don't shuffle it again.

    ``df`` should be dealt out by them already, so that a task writes few buckets.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tables/{table}"
    with _shuffles_freed(spark):
        df.write.bucketBy(n, *keys).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._table_path, out._table_name = path, table
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    spark = df.sparkSession
    if name := getattr(df, "_table_name", None):
        spark.sql(f"drop table if exists {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(df._table_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
