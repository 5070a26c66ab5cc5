"""Embedding near-dedup: PCA-ordered tiled comparison with suffix-norm bounds.

Equal vectors of a label collapse into one class first. Class vectors are rotated into
the axes of the whole table's covariance, largest variance first, and scaled to length
one. Two tiles are compared by products of the leading coordinates, block by block of
axes; the product of the remaining parts can't exceed the product of their norms, so a
pair stops at the block where its bound falls below the threshold. What is left is
decided by the cosine of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import Unions
from .storage import materialize

TILE = 1024
LEAD = 16


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their largest component, so that squares neither overflow nor vanish, and rows of length one."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def second_moments(vectors: DataFrame, dims: int) -> np.ndarray:
    """Sum of outer products of the unit vectors, over all rows: one dims x dims matrix a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(0)))[1]
                total += x.T @ x
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array((i * dims + j).astype(np.int32)), pa.array(total[i, j])], names=["cell", "value"])

    cells = vectors.select("embedding").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((dims, dims))
    for cell, value in cells:
        out[cell // dims, cell % dims] = out[cell % dims, cell // dims] = value
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE, lead: int = LEAD) -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``.

    ``vectors`` has ``vec_id, embedding, label``; other columns are ignored. Vectors link
    when their labels are equal and not null and their cosine is at least ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and so do vectors of different length. A null ``vec_id`` is no member of a
    component: it gets no links and a null component. Repeated rows of an id count as
    copies, and different vectors of one id are two members with links of their own. Lengths
    don't matter, however large or small. The result is empty for an empty table.
    """
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    fine = F.expr("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    v = materialize(v.withColumn("fine", F.coalesce(fine, F.lit(False))), "vectors")
    good = v.where("fine")
    # Equal vectors of a label are one class. The hash only groups; the vectors themselves are compared.
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # Different vectors may share an id, so classes have numbers of their own.
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    sizes = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    links = None
    for dims in sizes:
        part = _links(classes.where(F.size("embedding") == dims), dims, threshold, tile, min(lead, dims))
        links = part if links is None else links.unionByName(part)
    if links is None:
        links = classes.select(F.lit(0).cast("byte").alias("kind"), F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    links = materialize(links, "links")
    found = links.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    comp = connected_components(links.where("kind = 1"), "a", "b")
    classes = classes.join(found, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    least = classes.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    classes = classes.join(least, "component", "left")
    classes = classes.select("label", "embedding", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
    out = v.join(classes.withColumn("fine", F.lit(True)), ["label", "embedding", "fine"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", F.col("vec_id")).cast("long").alias("component_id"),
        (F.coalesce("component_id", F.col("vec_id")) == F.col("vec_id")).alias("kept"),
    )


def _links(classes: DataFrame, dims: int, threshold: float, tile: int, lead: int) -> DataFrame:
    """``(kind, a, b)``: kind 0 is ``b`` vectors linked to class ``a``, kind 1 an edge of a spanning forest of a pair of tiles."""
    axes = np.linalg.eigh(second_moments(classes, dims))[1][:, ::-1].copy()
    shared = classes.sparkSession.sparkContext.broadcast(axes)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _unit(_matrix(batch.column(3)))[1] @ shared.value
            cell = np.floor(y[:, 0] / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["rep", "n", "label", "embedding", "cell"])

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    cells = classes.select("rep", "n", "label", "embedding").mapInArrow(turn, f"rep {kinds['rep']}, n long, label {kinds['label']}, embedding array<double>, cell int")
    cells = materialize(cells, "cells")
    # Unit vectors that reach the threshold are at most `width` apart in every direction, so
    # only a cell and its next one along the first axis can hold such a pair. A cell is split
    # into tiles of bounded size by a hash of the id; every two tiles that can hold a pair meet.
    per = cells.groupBy("label", "cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    after = per.select("label", (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("next_tiles"))
    before = per.select("label", (F.col("cell") + 1).alias("cell"), F.col("tiles").alias("prev_tiles"))
    rows = cells.join(per, ["label", "cell"]).join(after, ["label", "cell"], "left").join(before, ["label", "cell"], "left")
    rows = rows.withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    none = F.expr("cast(array() as array<struct<cell:int,i:int,j:int,step:int,side:int>>)")
    own = F.expr("transform(sequence(0, tiles - 1), o -> named_struct('cell', cell, 'i', least(o, t), 'j', greatest(o, t), 'step', 0, 'side', if(t <= o, 0, 1)))")
    up = F.when(F.col("next_tiles").isNotNull(), F.expr("transform(sequence(0, next_tiles - 1), o -> named_struct('cell', cell, 'i', t, 'j', o, 'step', 1, 'side', 0))")).otherwise(none)
    down = F.when(F.col("prev_tiles").isNotNull(), F.expr("transform(sequence(0, prev_tiles - 1), o -> named_struct('cell', cell - 1, 'i', o, 'j', t, 'step', 1, 'side', 1))")).otherwise(none)
    rows = rows.select("rep", "n", "label", "embedding", F.explode(F.concat(own, up, down)).alias("at"))
    rows = rows.select("label", "at.cell", "at.i", "at.j", "at.step", F.col("at.side").alias("side"), F.col("rep").cast("long"), "n", "embedding")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rep, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        x, unit = _unit(_matrix(table.column("embedding")))
        norm2 = np.einsum("ij,ij->i", x, x)
        y = unit @ shared.value
        # Norms of what is left of each vector behind each block of axes.
        ends = [*range(lead, dims, lead), dims]
        rest = {e: np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", y[:, e:], y[:, e:]))) for e in ends}
        one = table.column("step")[0].as_py() == 0 and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        left = np.arange(len(rep)) if one else np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        # Keys are sorted along the leading axis, so that each block meets a narrow range only.
        left, right = left[np.argsort(y[left, 0])], right[np.argsort(y[right, 0])]
        linked, sets = np.zeros(len(rep), np.int64), Unions(len(rep))
        first = y[right, 0]
        for a in range(0, len(left), 256):
            block = left[a : a + 256]
            lo = np.searchsorted(first, y[block[0], 0] - width)
            near = right[lo : np.searchsorted(first, y[block[-1], 0] + width, "right")]
            partial = y[block, :lead] @ y[near, :lead].T
            p, q = np.nonzero(partial + np.outer(rest[lead][block], rest[lead][near]) >= threshold - 1e-9)
            partial, p, q = partial[p, q], block[p], near[q]
            if one:
                partial, p, q = partial[p < q], p[p < q], q[p < q]
            # Block by block of axes, until the product can't reach the threshold any more.
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                if not len(p):
                    break
                for b in range(0, len(p), 1 << 16):
                    partial[b : b + (1 << 16)] += np.einsum("ij,ij->i", y[p[b : b + (1 << 16)], lo:hi], y[q[b : b + (1 << 16)], lo:hi])
                open_ = partial + rest[hi][p] * rest[hi][q] >= threshold - 1e-9
                partial, p, q = partial[open_], p[open_], q[open_]
            for b in range(0, len(p), 1 << 16):
                u, w = p[b : b + (1 << 16)], q[b : b + (1 << 16)]
                hit = np.einsum("ij,ij->i", x[u], x[w]) / np.sqrt(norm2[u] * norm2[w]) >= threshold
                u, w = u[hit], w[hit]
                np.add.at(linked, u, n[w])
                np.add.at(linked, w, n[u])
                for s, t in zip(u.tolist(), w.tolist(), strict=True):
                    sets.join(s, t)
        some = np.flatnonzero(linked)
        root = np.array([sets.root(i) for i in some.tolist()], np.int64)
        edge = root != some
        return pa.table({
            "kind": pa.array(np.r_[np.zeros(len(some), np.int8), np.ones(edge.sum(), np.int8)]),
            "a": pa.array(np.r_[rep[some], rep[some][edge]].astype(np.int64)),
            "b": pa.array(np.r_[linked[some], rep[root[edge]] if edge.any() else np.zeros(0, np.int64)].astype(np.int64)),
        })

    return rows.groupBy("label", "cell", "i", "j", "step").applyInArrow(compare, "kind byte, a long, b long")
