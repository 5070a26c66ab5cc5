"""Sinks for the pipeline's tables, and the staged hand-off between its steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_COLUMNS = ["chunk_id", "document_id", "user_id", "kb_id", "ordinal", "text", "token_count", "char_start", "char_end"]
ENTITY_COLUMNS = ["mention_id", "chunk_id", "document_id", "user_id", "kb_id", "entity_type", "text", "char_start", "char_end", "score"]
REGION_COLUMNS = ["document_id", "user_id", "kb_id", "region_type", "page_number", "bounding_box", "status", "extractor_version"]


def insert_rows(rows: DataFrame, path: str, columns: list[str], most: int = 1_000_000) -> None:
    """Append ``columns`` of ``rows`` by tenant and knowledge base, at most ``most`` rows a file; all of them or, when the job fails, none.

    A row without tenant or knowledge base fails the insert. Nothing is shuffled: each task
    sorts its rows by tenant and writes its own files.
    """
    absent = [c for c in columns if c not in rows.columns]
    if absent:
        raise ValueError(f"rows lack {absent}")
    owned = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"row without {c}"))).otherwise(F.col(c)).alias(c) if c in ("user_id", "kb_id") else F.col(c) for c in columns]
    rows.select(*owned).write.mode("append").option("maxRecordsPerFile", most).partitionBy("user_id", "kb_id").parquet(path)


def save_chunks(chunks: DataFrame, path: str) -> None:
    insert_rows(chunks, path, CHUNK_COLUMNS)


def save_entities(mentions: DataFrame, path: str) -> None:
    insert_rows(mentions, path, ENTITY_COLUMNS)


def save_regions(regions: DataFrame, path: str) -> None:
    """Regions of a manifest; the bounding box is kept as JSON."""
    box = "bounding_box"
    if box in regions.columns and regions.schema[box].dataType.typeName() == "struct":
        regions = regions.withColumn(box, F.to_json(box))
    insert_rows(regions, path, REGION_COLUMNS)


def saved(spark: SparkSession, path: str, like: DataFrame, columns: list[str]) -> DataFrame:
    """What a sink holds, in the types of the rows that went in."""
    schema = like.select(*columns).schema
    return spark.read.schema(schema).parquet(path).select(*columns)


def stage(rows: DataFrame, path: str) -> None:
    """Write the input or result of a batch job as JSON lines by ``document_id, attempt``, so that a later attempt never reads an earlier one's files.

    Staging an attempt again replaces its own files only.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("document_id", "attempt").json(path)


def staged(spark: SparkSession, path: str, schema: str, current: DataFrame) -> DataFrame:
    """The staged rows of the current attempts (``document_id, attempt``) only; a line that isn't valid JSON is an error."""
    rows = spark.read.schema(f"{schema}, document_id long, attempt int").option("mode", "FAILFAST").json(path)
    return rows.join(current.select("document_id", F.col("attempt").cast("int").alias("attempt")), ["document_id", "attempt"], "left_semi")
