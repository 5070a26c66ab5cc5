"""Toxicity: a character n-gram linear classifier with naive-Bayes-scaled features.

Features are the distinct byte n-grams (3 to 5) of the lower-cased text, hashed into
2**18 buckets. Each is scaled by its naive Bayes log-count ratio between toxic and
other training texts; a logistic model with an L2 penalty is fitted on the scaled
features. Only the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernels import BYTE_VALUE, U64, fold, text_slices

BITS = 18
ORDERS = (3, 4, 5)
#: Labelled texts of each class that the fit uses at most; the ones with the smallest hash of their id.
TRAIN_PER_CLASS = 2000


@dataclass
class Model:
    weights: np.ndarray  # log-count ratio times fitted weight, by bucket
    bias: float


def _buckets(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that start at each byte, for each order; those that cross a row's end are for the caller to leave."""
    g, out = BYTE_VALUE[data].copy(), []
    step = U64(0xD6E8FEB86659FD93)
    value = g.copy()
    for n in range(2, max(ORDERS) + 1):
        k = len(data) - n + 1
        if k <= 0:
            out += [np.zeros(0, np.int32)] * (n in ORDERS)
            continue
        g = g[:k] * step
        g += value[n - 1 :]
        if n in ORDERS:
            h = g ^ (g >> U64(29))
            h *= U64(0xBF58476D1CE4E5B9)
            out.append((h >> U64(64 - BITS)).astype(np.int32))
    return out


class _Distinct:
    """Distinct buckets of one row after another, with one scratch table."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, np.int32)

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        for _, offsets, data in text_slices(column):
            offsets, data = fold(offsets, data)
            grams = _buckets(offsets, data)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                x = np.concatenate([g[a : max(a, b - n + 1)] for g, n in zip(grams, ORDERS, strict=True)])
                at = np.arange(len(x), dtype=np.int32)
                self.seen[x] = at
                yield x[self.seen[x] == at]


def _blocks(n: int) -> list[slice]:
    """Stretches of features that are worked on at once, so that wider copies of all of them are never held."""
    return [slice(i, i + (1 << 19)) for i in range(0, n, 1 << 19)]


def log_count_ratio(flat: np.ndarray, of: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The naive Bayes log ratio of each bucket's presence in both classes, smoothed by one text in each; bucket ``flat[i]`` is in text ``of[i]``."""
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for s in _blocks(len(flat)):
        one = np.bincount(flat[s], weights=y[of[s]], minlength=1 << BITS)
        pos += one
        neg += np.bincount(flat[s], minlength=1 << BITS) - one
    return np.log((pos + 1) / (y.sum() + 2)) - np.log((neg + 1) / (len(y) - y.sum() + 2))


def fit(rows: list[np.ndarray], toxic: np.ndarray, prior: float, rounds: int = 50, penalty: float = 1e-2, rate: float = 0.02) -> Model:
    """Fit on the distinct buckets of labelled texts; ``prior`` is the share of toxic texts among all labelled ones.

    Without both classes the score is the prior for every text.
    """
    y = np.asarray(toxic, np.float64)
    logit = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), logit)
    flat, n = np.concatenate(rows), len(rows)
    of = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    del rows  # views of a second copy
    ratio = log_count_ratio(flat, of, y)
    w, b = np.zeros(1 << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    blocks = _blocks(len(flat))
    scaled = np.empty(len(flat), np.float32)
    for s in blocks:
        scaled[s] = ratio[flat[s]]
    # Each class weighs half; the bias is moved to the prior at the end.
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    for t in range(1, rounds + 1):
        z = np.full(n, b)
        for s in blocks:
            z += np.bincount(of[s], weights=w[flat[s]] * scaled[s], minlength=n)
        err = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        g, gb = penalty * w, err.sum()
        for s in blocks:
            g += np.bincount(flat[s], weights=err[of[s]] * scaled[s], minlength=1 << BITS)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model(w * ratio, b + logit)


def score(texts: pa.Array, model: Model) -> np.ndarray:
    z = np.array([model.weights[x].sum() for x in _Distinct().rows(texts)], np.float64) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def sample_ids(labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, those with the smallest hash: a bounded training sample."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    order = [F.xxhash64(F.col("doc_id"), F.lit(10)), F.col("doc_id"), F.col("toxic")]
    one = [known.where(F.col("toxic") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    return one[0].unionByName(one[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model:
    """Fit on the texts of a bounded sample of ``labels`` (doc_id, toxic); labels that are null or name no text are left out.

    Of several texts of one id the smallest counts, once for each label. The driver gets the
    distinct buckets of a text, 2**18 at most, and never a text.
    """
    picked = sample_ids(labels.distinct(), per_class)
    known = labels.where("doc_id is not null and toxic in (0, 1)").agg(F.avg(F.col("toxic").cast("double"))).first()[0]

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = _Distinct()
        for batch in batches:
            rows = list(distinct.rows(batch.column(2)))
            flat = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "toxic", "buckets"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = texts.select("doc_id", "toxic", "text").mapInArrow(buckets, f"doc_id {kind}, toxic int, buckets array<int>").orderBy("doc_id", "toxic").select("toxic", "buckets").toArrow()
    toxic = rows.column("toxic").to_numpy()
    sets = [x.values.to_numpy() for chunk in rows.column("buckets").chunks for x in chunk]
    del rows
    handed = [sets]
    del sets
    return fit(handed.pop(), toxic, 0.0 if known is None else float(known))


def annotate(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1) added to every row; a null or empty text gets the score of the bias alone. A column of that name gives way."""
    docs = docs.drop("toxic_score")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(batch.column(at), own))], names=[*batch.schema.names, "toxic_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("toxic_score", DoubleType())]))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted)`` for every row: score 0 to 1, predicted 1 from 0.5 on. Repeated rows give repeated results."""
    scored = annotate(docs.select(id_col, text_col), model, text_col)
    return scored.select(id_col, F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
