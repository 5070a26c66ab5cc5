"""Readers, tenant scoping and the mapping of the given tables to documents of tenants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType


@dataclass(frozen=True)
class TenantScope:
    """Every read of tenant data goes through a scope; one without identity is refused."""

    user_id: str
    kb_id: str | None = None

    def __post_init__(self):
        if not self.user_id:
            raise PermissionError("no tenant identity")

    def apply(self, df: DataFrame) -> DataFrame:
        df = df.where(F.col("user_id") == self.user_id)
        return df if self.kb_id is None else df.where(F.col("kb_id") == self.kb_id)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_id, user_id, kb_id, text``: the source of a text is its tenant, its language the knowledge base."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"), F.col("lang").alias("kb_id"), "text")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files below ``path``: ``filename, content_type, text``; a file name whose extension isn't accepted is an error when it is read.

    ``filename`` is the path below ``path``, so that ground truth can name it.
    """
    from ..functions.text import content_type

    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("f"), F.col("value").alias("text"))
    root = "/" + path.split("://", 1)[-1].strip("/") + "/"
    name = F.regexp_replace(F.substring_index(F.url_decode(F.regexp_replace("f", r"\+", "%2B")), root, -1), "^/+", "")
    kind = F.coalesce(content_type(name), F.raise_error(F.concat(F.lit("extension not accepted: "), name)).cast("string"))
    return raw.select(name.alias("filename"), kind.alias("content_type"), "text")


def ground_truth(spark: SparkSession, path: str, section: str, entry: str | None = None) -> DataFrame:
    """One section of ground truth files, a row an entry. ``entry`` names its fields; without it, one task more reads all files for them first."""
    schema = entry and StructType([StructField(section, ArrayType(StructType.fromDDL(entry)))])
    return spark.read.json(path, multiLine=True, schema=schema).select(F.explode(section).alias("x")).select("x.*")


def replace_documents(existing: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of the documents in ``fresh`` replace the ones that ``existing`` has of them."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(fresh)


def insert_new(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``fresh`` whose key neither ``existing`` nor an earlier row has."""
    return fresh.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
