"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import gumbel_top_k, log_weights, models, target_sample

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ratio = models(docs, target_sample(_table(spark, sf_dir, "labels")))
    return gumbel_top_k(log_weights(docs, ratio), fraction=0.5, seed=1)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lsh_forest import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), 0.8)


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages against a replica with known damage."""
    from .warc_fixity import audit, damaged

    pages = _table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), 0.93)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces

    return pack(pieces(_table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_bytes

    return repeated_bytes(_table(spark, sf_dir, "documents"), 50)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicate

    out = deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return out.select("doc_id", "n_lines", "n_repeats", "n_near", "n_links", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~held_out())
    scored = classify(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written in the file format, and what the files say of each document."""
    from .token_files import read, write

    return read(spark, write(_table(spark, sf_dir, "documents")))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import align

    return align(_table(spark, sf_dir, "documents"))[0]


QUERIES = {
    "op1_quality_resampling": op1_quality_resampling,
    "op2_decontamination": op2_decontamination,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_warc_fixity": op4_warc_fixity,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_token_files": op11_token_files,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_token_alignment": op13_token_alignment,
}
