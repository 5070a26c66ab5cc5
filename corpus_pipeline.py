"""Corpus cleaning in five stages, from `documents` to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written and read
again as the next one's ``docs``. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.decontaminate import leaks
from graphloom.llm.line_dedup import deduplicate
from graphloom.llm.lsh_forest import near_duplicates
from graphloom.llm.packing import pack, pieces
from graphloom.llm.storage import materialize
from graphloom.llm.toxicity import annotate, train


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but ``doc_id`` and ``text`` renamed by place, so that no operator's own columns clash with them."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)))


def back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of :func:`apart`, named as in ``docs`` again."""
    return out.select(*apart(docs).columns).toDF(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among `docs`."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return back(annotate(apart(docs), train(docs, labels)).where("toxic_score < 0.5"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of equal or near-equal lines the first stays, short ones too; a document that keeps only blank lines goes."""
    cut = deduplicate(apart(docs), short=True).where(r"n_repeats = 0 or kept_text rlike '\\S'")
    changed = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        i = docs.columns.index("n_chars")
        changed[f"column_{i}"] = F.when(F.col("n_repeats") > 0, F.length("kept_text")).otherwise(F.col(f"column_{i}")).cast(docs.schema["n_chars"].dataType)
    return back(cut.withColumns(changed), docs)


def content_key(docs: DataFrame):
    """A 64-bit name of a document's id and text: texts that share an id are documents of their own, repeated rows are one."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id; null ids come last. Texts that share an id are told apart; repeated rows of one id and text stay or go together."""
    named = docs.select(content_key(docs).alias("doc_id"), "text")
    near = near_duplicates(named, 0.8).where("n_links > 0").select(F.col("doc_id").alias("_key"), "component_id").distinct()
    ids = docs.select(content_key(docs).alias("_key"), "doc_id").distinct()
    member = materialize(near.join(ids, "_key"), "members")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    first = member.groupBy("component_id").agg(F.min(place).getField("_key").alias("_key"))
    others = member.select("_key").join(first, "_key", "left_anti")
    return docs.join(others, content_key(docs) == others["_key"], "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or within the edit budget, go; another text of the same id stays."""
    named = docs.select(content_key(docs).alias("doc_id"), "text")
    found = materialize(leaks(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_key")).distinct(), "leaks")
    return docs.join(found, content_key(docs) == found["_key"], "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents that are left."""
    return pack(pieces(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("best-fit packing", pack_sequences),
]

#: Trained weights, min-hashes and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
