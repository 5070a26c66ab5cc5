"""Batch jobs over the chunks of documents: their plan, and what of their results is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH = 50


def plan_batches(chunks: DataFrame, size: int = BATCH) -> DataFrame:
    """Adds ``batch``: each document's chunks in order of ordinal, ``size`` at a time, from 0."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("ordinal", "chunk_id")) - 1
    return chunks.withColumn("batch", F.floor(place / size).cast("int"))


def kept_results(batches: DataFrame, results: DataFrame, done: DataFrame, current: DataFrame) -> DataFrame:
    """The results (``document_id, attempt, batch, chunk_id, ...``) that are to be saved.

    Results of an attempt that isn't the current one (``document_id, attempt``) go, so do
    results for chunks outside their batch, and all of a batch of which a chunk (``chunk_id``
    in ``done``) has mentions already, since batches are saved whole or not at all.
    """
    place = batches.select("document_id", "batch", "chunk_id")
    saved = place.join(done.select("chunk_id").distinct(), "chunk_id", "left_semi").select("document_id", "batch").distinct()
    return (
        results.join(current.select("document_id", "attempt"), ["document_id", "attempt"], "left_semi")
        .join(place, ["document_id", "batch", "chunk_id"], "left_semi").join(saved, ["document_id", "batch"], "left_anti")
    )


def vector_status(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """``document_id, chunks, vectors, status``: ``ok`` where a document has as many vectors as chunks, else ``mismatch``."""
    c = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    v = vectors.groupBy("document_id").agg(F.count("*").alias("vectors"))
    j = c.join(v, "document_id", "full").na.fill(0, ["chunks", "vectors"])
    return j.withColumn("status", F.when(F.col("chunks") == F.col("vectors"), "ok").otherwise("mismatch"))


def backfill(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with the vector of their place in their document (``document_id, ordinal, embedding``); documents whose counts differ get none at all."""
    ok = vector_status(chunks, vectors).where("status = 'ok'").select("document_id")
    by = Window.partitionBy("document_id").orderBy("ordinal")
    c = chunks.join(ok, "document_id", "left_semi").withColumn("_place", F.row_number().over(by))
    v = vectors.withColumn("_place", F.row_number().over(by)).select("document_id", "_place", "embedding")
    return c.join(v, ["document_id", "_place"]).drop("_place")
