"""Centroid clustering of quantised vectors: equal vectors count once, with their multiplicity.

All arithmetic is on integers, so the result depends on nothing but the data: no order of
rows, number of partitions or lost executor changes a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

WIDTH, SCALE, CLUSTERS, ROUNDS = 64, 256, 40, 5
#: Quantised components lie in between these, so that a squared distance fits 64 bits.
LARGEST = 1 << 27
#: A vector with more than this share of the rows is joined by broadcast; there can't be more of them than its inverse.
HOT_SHARE = 1 / 512
_EXACT = 1 << 22  # up to here, sums of products are exact in doubles


def quantised(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``vec_id, q`` of the vectors with exactly ``width`` components, none null or non-finite: each component is ``floor(scale * x)``.

    A component beyond 2**27 is an error, since distances wouldn't fit.
    """
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    kept = vectors.where(e.isNotNull() & (F.size(e) == width)).where(fine).select("vec_id", q.alias("q"))
    small = F.forall("q", lambda x: F.abs(x) < LARGEST)
    return kept.select("vec_id", F.when(small, F.col("q").cast("array<int>")).otherwise(F.raise_error(F.lit("a component is beyond the range of the quantised vectors"))).alias("q"))


def distinct(rows: DataFrame) -> DataFrame:
    """``q, weight``: each distinct vector once, with its number of rows; counted by task before anything is shuffled."""
    return rows.groupBy("q").agg(F.count("*").alias("weight"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = 2) -> np.ndarray:
    """The vectors of the ids with the smallest SHA-256 of ``seed:vec_id``; a null id has none. Equal ids go by their vectors."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    best = rows.where("vec_id is not null").select(h.alias("h"), "q").orderBy("h", "q").limit(clusters).collect()  # as many rows as clusters
    return np.array([r.q for r in best], np.int64)


def _nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(cluster, squared distance)`` of each row; the smaller number wins ties."""
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if most < _EXACT and q.shape[1] <= 256:
        x, c = q.astype(np.float64), centroids.astype(np.float64)
        d = ((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    else:
        d = np.stack([((q - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(q)), best]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``points`` and ``cluster, distance``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cluster, d = _nearest(_matrix(batch.column(0)), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster.astype(np.int32)), pa.array(d)], names=["q", "weight", "cluster", "distance"])

    return points.select("q", "weight").mapInArrow(run, "q array<int>, weight long, cluster int, distance long")


def _sums(points: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and componentwise sum of each cluster that has any; a task sends one row a cluster, and the driver gets one row a cluster."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            if len(batch):
                q, w = _matrix(batch.column(0)), batch.column(1).to_numpy()
                cluster, _ = _nearest(q, centroids)
                np.add.at(weight, cluster, w)
                np.add.at(total, cluster, q * w[:, None])
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(weight[at]), pa.array(list(total[at]), pa.list_(pa.int64()))], names=["cluster", "weight", "total"])

    part = points.select("q", "weight").mapInArrow(run, "cluster int, weight long, total array<long>")
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    rows = part.groupBy("cluster").agg(wide(F.col("weight")).alias("weight"), F.array(*(wide(F.col("total")[i]) for i in range(width))).alias("total")).collect()
    return {r.cluster: (int(r.weight), [int(x) for x in r.total]) for r in rows}


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = 2) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that :func:`quantised` keeps.

    Lloyd's rounds run on the distinct vectors alone, with integer sums weighted by
    multiplicity; a centroid becomes the floor of its mean, an empty one stays. The last
    assignment is joined back to the rows: vectors with many rows by broadcast, of which
    there are ``1 / HOT_SHARE`` at most, all others by their components.

    Ties go to the smaller cluster. Repeated rows and ids are rows of their own; a row with a
    null id is clustered but never a first centroid. Fewer vectors than ``clusters`` make
    fewer centroids; without any, the result is empty. Columns besides ``vec_id`` and
    ``embedding`` are not looked at.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors.select("vec_id", "embedding"), width, scale)
    points = materialize(distinct(rows), "points")
    try:
        centroids = first_centroids(rows, clusters, seed)
        kind = rows.schema["vec_id"].dataType.simpleString()
        if not len(centroids):
            return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        for _ in range(rounds):
            centroids = centroids.copy()
            for c, (n, total) in _sums(points, centroids).items():
                centroids[c] = [t // n for t in total]
        done = materialize(_assigned(points, centroids), "assigned")
    finally:
        discard(points)
    wide = F.sum((F.col("weight") * F.col("distance").cast("decimal(38,0)")).cast("decimal(38,0)")).cast("long")
    inertia = {r.cluster: r.x for r in done.groupBy("cluster").agg(wide.alias("x")).collect()}  # one row a cluster
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, inertia[c], sum(inertia.values()), names[c]) for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    total = done.agg(F.sum("weight")).first()[0]
    hot = done.where(F.col("weight") > F.lit(total * HOT_SHARE)).select("q", "cluster", "distance")
    rest = done.where(F.col("weight") <= F.lit(total * HOT_SHARE)).select("q", "cluster", "distance")
    met = rows.join(F.broadcast(hot), "q", "left")
    out = met.where("cluster is not null").select("vec_id", "cluster", "distance")
    out = out.unionByName(met.where("cluster is null").select("vec_id", "q").join(rest, "q").select("vec_id", "cluster", "distance"))
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
