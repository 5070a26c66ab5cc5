"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample.

Words and word pairs are hashed into buckets. The raw model counts all texts; the target
model counts a bounded sample of the texts labelled good. A text's log weight is the sum
of log(target / raw) over its n-grams, the ratio of the two models. The k texts with the largest sum of log
weight and Gumbel noise are kept, which samples without replacement by weight.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, fold, grams, row_sums, text_slices, words
from .storage import materialize

BUCKETS = 10_000
#: Texts of the target sample at most: the labelled good ones with the smallest hash of their id.
TARGET_TEXTS = 10_000
#: Counts that the raw model lends to the target model, so that unseen n-grams speak neither way.
PRIOR_COUNTS = 1000.0


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(buckets, first one of each row and the end)`` for words and for pairs of words, slice by slice."""
    for _, offsets, data in text_slices(column):
        h, _, first = words(*fold(offsets, data))
        pairs, starts = grams(h, first, 2)
        yield (h % U64(BUCKETS)).astype(np.int32), first, (pairs % U64(BUCKETS)).astype(np.int32), starts


def models(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """log(target / raw) by bucket. ``target_ids`` (doc_id) is a bounded sample. Raw counts are smoothed by one a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False)
            row = 0
            for b1, f1, b2, f2 in _features(batch.column(0)):
                raw += np.bincount(b1, minlength=BUCKETS) + np.bincount(b2, minlength=BUCKETS)
                for i in np.flatnonzero(good[row : row + len(f1) - 1]).tolist():
                    target += np.bincount(b1[f1[i] : f1[i + 1]], minlength=BUCKETS) + np.bincount(b2[f2[i] : f2[i + 1]], minlength=BUCKETS)
                row += len(f1) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])

    flagged = docs.select("doc_id", "text").join(F.broadcast(target_ids.select("doc_id").distinct().withColumn("good", F.lit(True))), "doc_id", "left")
    counts = flagged.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(run, "bucket int, raw long, target long")
    raw, target = np.ones(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[bucket] += r
        target[bucket] += t
    raw /= raw.sum()
    target = (target + PRIOR_COUNTS * raw) / (target.sum() + PRIOR_COUNTS)
    return np.log(target) - np.log(raw)


def target_sample(labels: DataFrame, limit: int = TARGET_TEXTS) -> DataFrame:
    known = labels.where("doc_id is not null and quality = 1").select("doc_id").distinct()
    return known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(1)), "doc_id").limit(limit)


def log_weights(docs: DataFrame, ratio: np.ndarray, length: float | None = None) -> DataFrame:
    """``doc_id, n_features, log_weight``; a text without words has 0 features and weight 0.

    The weight is the log of the ratio of the two models, summed over all n-grams. With
    ``length``, it is the mean over the n-grams times that number, as if all texts had so many.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, w = [np.zeros(0, np.int64)], [np.zeros(0)]
            for b1, f1, b2, f2 in _features(batch.column(1)):
                k = np.diff(f1) + np.diff(f2)
                n.append(k)
                total = row_sums(shared.value[b1], f1) + row_sums(shared.value[b2], f2)
                w.append(total if length is None else total / np.maximum(k, 1) * length)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(w))], names=["doc_id", "n_features", "log_weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_features long, log_weight double")


def kth_largest(codes: DataFrame, k: int) -> int | None:
    """The exact k-th largest of ``_code`` (see :func:`encode_doubles`), by counts of 16 bits at a time.

    At most 65,536 counts reach the driver in each of the four passes. None if there are fewer than k values.
    """
    if k <= 0:
        return None
    prefix = 0
    for level in (48, 32, 16, 0):
        part = codes.where(F.shiftrightunsigned("_code", level + 16) == prefix) if level < 48 else codes
        digit = F.shiftrightunsigned("_code", level).bitwiseAND(0xFFFF)
        counts = sorted(((r[0], r[1]) for r in part.groupBy(digit.alias("d")).count().collect()), reverse=True)
        for d, n in counts:
            if n >= k:
                prefix = (prefix << 16) | d
                break
            k -= n
        else:
            return None
    return prefix


def encode_doubles(values: np.ndarray) -> np.ndarray:
    """Signed 64-bit codes whose unsigned order is the order of the doubles."""
    raw = np.ascontiguousarray(values, np.float64).view(np.int64)
    return np.where(raw < 0, ~raw, raw ^ np.int64(-(2**63)))


def gumbel_top_k(weighted: DataFrame, fraction: float = 0.5, seed: int = 1) -> DataFrame:
    """Adds ``gumbel_key`` and ``kept`` to rows of ``doc_id, log_weight``: exactly the k largest keys are kept.

    ``k = ceil(fraction * rows)``. The noise is a function of the id and the seed, so a rerun
    gives the same sample. Repeated rows have equal keys; of rows tied at the last place, as
    many as fit are kept, the first ones of the written table. Columns of these
    names give way.
    """
    weighted = weighted.drop("gumbel_key", "kept", "_row")
    h = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11)
    u = (h.cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = weighted.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))).withColumn("_row", F.monotonically_increasing_id())
    keyed = materialize(keyed, "keys")
    k = math.ceil(fraction * keyed.count())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encode_doubles(batch.column(0).to_numpy(zero_copy_only=False)))], names=["_code"])

    codes = materialize(keyed.select("gumbel_key").mapInArrow(code, "_code long"), "codes")
    at = kth_largest(codes, k)
    if at is None:
        return keyed.withColumn("kept", F.lit(False)).drop("_row")
    raw = at ^ (1 << 63) if at >> 63 else ~at & ((1 << 64) - 1)
    least = F.lit(struct.unpack("<d", struct.pack("<Q", raw))[0])
    above, tied = keyed.agg(F.count_if(F.col("gumbel_key") > least), F.count_if(F.col("gumbel_key") == least)).first()
    if above + tied == k:
        return keyed.withColumn("kept", F.col("gumbel_key") >= least).drop("_row")
    # The tied rows that fit are found like the k largest keys: the smallest row numbers of them.
    top = (1 << 63) - 1
    last = top - kth_largest(keyed.where(F.col("gumbel_key") == least).select((F.lit(top) - F.col("_row")).alias("_code")), k - above)
    return keyed.withColumn("kept", (F.col("gumbel_key") > least) | ((F.col("gumbel_key") == least) & (F.col("_row") <= last))).drop("_row")
