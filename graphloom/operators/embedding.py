"""Embedding of texts behind an interface, with a deterministic default."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 384
#: Fixed value: the sentence that introduces a query, not a document.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def hashed(texts: list[str], width: int = WIDTH) -> np.ndarray:
    """A stand-in for a model: signed word hashes, scaled to length one; a text without words is a unit vector too."""
    out = np.zeros((len(texts), width), np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % width] += 1 if h >> 31 else -1
    out[~out.any(axis=1), 0] = 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def embed(chunks: DataFrame, model: Callable[[list[str]], np.ndarray] = hashed) -> DataFrame:
    """Adds ``embedding`` in Arrow batches; the model must give one vector a text."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            v = model(s.fillna("").tolist())
            if len(v) != len(s):
                raise ValueError("as many vectors as texts are needed")
            yield pd.Series(list(v))

    return chunks.withColumn("embedding", run("text"))


def backfill(chunks: DataFrame, model: Callable[[list[str]], np.ndarray] = hashed) -> DataFrame:
    """Only chunks without an embedding get one; ``refreshed`` tells which."""
    have = chunks.where("embedding is not null").withColumn("refreshed", F.lit(False))
    return have.unionByName(embed(chunks.where("embedding is null").drop("embedding"), model).withColumn("refreshed", F.lit(True)).select(*chunks.columns, "refreshed"))
