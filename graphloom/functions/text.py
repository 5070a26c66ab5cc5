"""Scalar text functions: byte offsets, normalization, fixed word lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Function words that are never an entity.
FUNCTION_WORDS = [
    "i", "me", "my", "mine", "myself",
    "we", "us", "our", "ours", "ourselves",
    "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself",
    "she", "her", "hers", "herself",
    "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves",
    "someone", "anyone", "everyone", "no one", "nobody",
    "something", "anything", "everything", "nothing",
    "here", "there",
]

# The entity types a knowledge base starts with.
ENTITY_TYPES = ["person", "organization", "location", "concept", "event", "work_of_art", "date_time"]

# Accepted file extensions.
CONTENT_TYPES = {
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
}


def nfkc(text: Column) -> Column:
    """Unicode NFKC, which Spark SQL has no function for; only text beyond ASCII goes to Python."""

    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    beyond = F.when(~text.rlike(r"^\p{ASCII}*$"), text)
    return F.coalesce(F.pandas_udf(run, StringType())(beyond), text)


def normalized(text: Column, compatibility: bool = True) -> Column:
    """Lower case, NFKC unless told otherwise, and single spaces."""
    t = F.lower(text)
    if compatibility:
        t = nfkc(t)
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def content_type(name: Column) -> Column:
    """Media type by file extension; null for one that isn't accepted."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv)), ext)


def is_function_word(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(FUNCTION_WORDS)


def capitalised(text: Column) -> Column:
    """Starts with an ASCII capital once one leading article is set aside."""
    return F.regexp_replace(text, r"(?i)^(the|a|an)\s+", "").rlike("^[A-Z]")
