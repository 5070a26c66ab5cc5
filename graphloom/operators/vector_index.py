"""A vector index of coarse cells: k-means centres, and for each cell the widest angle of its vectors.

A search looks into the cells nearest to a query. By the triangle inequality of angles, no
vector of a cell is nearer to the query than the cell's centre less the cell's radius, so
an exact search knows which further cells it may leave out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut

#: Vectors that cells are fitted on at most, cells at most, vectors of a block, queries that are sent on in one piece.
SAMPLE, MOST_CELLS, BLOCK, QUERIES = 200_000, 4096, 1024, 1024
#: Blocks of a shelf, and queries of a piece that meet it at once.
SHELF, AT_ONCE = 8, 64
#: Rounding of scores, and the slack of bounds for it.
DIGITS, SLACK = 6, 2e-6


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _rows(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by ``QUERIES`` at most, which bounds a product with all centres."""
    for b in batches:
        for i in range(0, len(b), QUERIES):
            yield b.iloc[i : i + QUERIES]


def centres(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Unit centres by Spark's k-means on up to ``SAMPLE`` unit vectors, chosen by a hash of the id; about the root of the vectors' number of cells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    if not n:
        return np.zeros((0, 0))
    cells = max(1, min(cells or int(n**0.5), MOST_CELLS, n))
    share = min(1.0, SAMPLE / n)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).where(size > 0)
    unit = unit.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double") / size)).alias("features"))
    if unit.isEmpty():
        return np.eye(1, len(vectors.first()["embedding"]))
    return _unit(np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(unit).clusterCenters()))


def build(vectors: DataFrame, width: int, cells: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(cells, blocks)`` of ``vectors`` (``id, embedding``): every vector of ``width`` components is in one block.

    Cells: ``cell, centre, radius, n``. Blocks hold up to about ``BLOCK`` vectors of a cell:
    ``cell, block, ids, flat``. A cell that many vectors share has as many blocks as it needs.
    Null vectors and ones of another width are left out. Zero vectors are at a right angle to everything.
    """
    v = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == width)).select("id", "embedding")
    c = centres(v, cells, seed)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches):
            cos = _unit(_rows(b.embedding)) @ c.T
            best = cos.argmax(axis=1)
            yield pd.DataFrame({"id": b.id, "embedding": b.embedding, "cell": best.astype(np.int32), "angle": np.arccos(np.clip(cos[np.arange(len(b)), best], -1, 1))})

    placed = cut(v.mapInPandas(assign, f"id {v.schema['id'].dataType.simpleString()}, embedding array<float>, cell int, angle double"))
    spark = vectors.sparkSession
    known = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cell int, centre array<double>")
    facts = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    table = cut(known.join(facts, "cell"))
    deal = placed.join(F.broadcast(table.select("cell", F.ceil(F.col("n") / BLOCK).alias("parts"))), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")))
    one = F.sort_array(F.collect_list(F.struct("id", "embedding")))
    blocks = deal.groupBy("cell", "block").agg(one.alias("x")).select("cell", "block", F.col("x.id").alias("ids"), F.flatten("x.embedding").alias("flat"))
    return table, cut(blocks)


def _best(score: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and rounded scores of each row's ``k`` best by rounded score, then id, of those that reach the row's ``least``."""
    floor = least - SLACK
    near = score >= floor[:, None]
    if score.shape[1] > k and near.sum() > 4 * k * len(score):
        floor = np.maximum(floor, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] - SLACK)
        near = score >= floor[:, None]
    row, col = np.nonzero(near & (score > -np.inf))
    value = np.round(score[row, col], DIGITS) + 0.0
    order = np.lexsort((ids[col], -value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.searchsorted(row, row) if len(row) else row
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep], value[keep]


def _shelves(cells: list) -> list[tuple[int, int, int, int]]:
    """``(cell, run, shelf, place)``: the runs of ``SHELF`` blocks of each cell, and where they stand; a shelf holds about ``SHELF`` blocks."""
    out, shelf, full, place = [], 0, 0, 0
    for r in cells:
        parts = max(1, -(-r.n // BLOCK))
        for run in range(-(-parts // SHELF)):
            size = min(SHELF, parts - run * SHELF) * min(BLOCK, r.n)
            if full and full + size > SHELF * BLOCK:
                shelf, full, place = shelf + 1, 0, 0
            out.append((r.cell, run, shelf, place))
            full, place = full + size, place + 1
    return out


def _probe(queries: DataFrame, cells: list, first: int, count: int | None, exact: bool) -> DataFrame:
    """``shelf, query_ids, flat, least, need``: the queries that have cells of a shelf in their turn, nearest first, in pieces.

    ``need`` has a bit for each query and place of the shelf. In the exact turn those cells
    count whose bound reaches ``least``. A query is sent once to a shelf, not once to a cell.
    """
    centre, radius = np.array([r.centre for r in cells]), np.array([r.radius for r in cells])
    number = {r.cell: i for i, r in enumerate(cells)}
    stand: dict[int, list[int]] = {}
    for cell, _, shelf, _ in _shelves(cells):
        stand.setdefault(shelf, []).append(number[cell])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches):
            q, least = _rows(b.q), b["least"].to_numpy(np.float64)
            angle = np.arccos(np.clip(_unit(q) @ centre.T, -1, 1))
            turn = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1)
            keep = turn >= first if count is None else (turn >= first) & (turn < first + count)
            if exact:
                keep &= np.cos(np.maximum(0.0, angle - radius)) >= least[:, None] - SLACK
            ids = b.query_id.to_numpy()
            for shelf, own in stand.items():
                need = keep[:, own]
                at = np.flatnonzero(need.any(axis=1))
                if len(at):
                    yield pd.DataFrame({"shelf": [np.int32(shelf)], "query_ids": [ids[at]], "flat": [q[at].ravel()], "least": [least[at]], "need": [np.packbits(need[at], axis=1).tobytes()]})

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "q", "least").mapInPandas(run, f"shelf int, query_ids array<{kind}>, flat array<double>, least array<double>, need binary")


def _compare(probes: DataFrame, index: tuple[list, DataFrame], k: int) -> DataFrame:
    """``query_id, id, score``: each shelf of vectors with each piece of queries for it; a pair gives ``k`` rows a query at most."""
    cells, blocks = index
    places = _shelves(cells)
    known = blocks.sparkSession.createDataFrame(places, "cell int, run long, shelf int, place int")
    run_of = F.floor(F.col("block") / SHELF).alias("run")
    held = blocks.select("cell", run_of, "ids", F.col("flat").alias("held")).join(F.broadcast(known), ["cell", "run"])
    # A shelf's vectors are one row, of SHELF * BLOCK vectors or so; each piece meets it once.
    one = F.collect_list(F.struct("place", "ids", "held")).alias("x")
    number = F.flatten(F.transform("x", lambda r: F.array_repeat(r["place"], F.size(r["ids"]))))
    shelves = held.groupBy("shelf").agg(one).select("shelf", F.flatten("x.ids").alias("ids"), F.flatten("x.held").alias("held"), number.alias("place"))
    kind, id_kind = probes.schema["query_ids"].dataType.elementType.simpleString(), blocks.schema["ids"].dataType.elementType.simpleString()
    values = lambda column, i: column[i].values.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                asked, ids, place = b.column(0)[i].values, b.column(4)[i].values, values(b.column(6), i)
                v = _unit(values(b.column(5), i).astype(np.float64).reshape(len(ids), -1))
                q, least = _unit(values(b.column(1), i).reshape(len(asked), -1)), values(b.column(2), i)
                need = np.unpackbits(np.frombuffer(b.column(3)[i].as_py(), np.uint8).reshape(len(asked), -1), axis=1).view(bool)
                number = ids.to_numpy(zero_copy_only=False)
                for s in range(0, len(asked), AT_ONCE):
                    own = slice(s, s + AT_ONCE)
                    score = np.where(need[own][:, place], q[own] @ v.T, -np.inf)
                    row, col, value = _best(score, number, least[own], k)
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(row + s)), ids.take(pa.array(col)), pa.array(value)], names=["query_id", "id", "score"])

    pairs = probes.join(shelves, "shelf").select("query_ids", "flat", "least", "need", "ids", "held", "place")
    return pairs.mapInArrow(run, f"query_id {kind}, id {id_kind}, score double")


def _top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int = 12, probes: int = 8, exact: bool = False) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` vectors nearest to each of ``queries`` (``query_id, q``) by cosine to six digits, ties by id.

    A plain search looks into the ``probes`` nearest cells, see :func:`tuned`. The exact one then also into
    every cell whose bound reaches the ``k``-th score found so far. The driver gets the
    cells, ``MOST_CELLS`` at most. Null queries are left out.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    table, blocks = index
    cells = table.collect()
    asked = queries.where("q is not null").select("query_id", "q", F.lit(-2.0).alias("least"))
    if not cells:
        return _top(asked.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score")).limit(0), k)
    found = _top(_compare(_probe(asked, cells, 0, probes, False), (cells, blocks), k), k)
    if not exact:
        return found
    found = cut(found)
    least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = asked.drop("least").join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    more = _compare(_probe(rest, cells, probes, None, True), (cells, blocks), k)
    return _top(found.drop("rank").unionByName(more), k)


def tuned(index: tuple[DataFrame, DataFrame], k: int = 12, target: float = 0.97, sample: int = 256, seed: int = 7) -> int:
    """How many nearest cells find the share ``target`` of the ``k`` nearest vectors, by exact searches for up to about ``sample`` of the indexed vectors themselves."""
    table, blocks = index
    cells = table.collect()
    total = sum(r.n for r in cells)
    if not total:
        return 1
    held = blocks.select("cell", F.explode(F.arrays_zip("ids", F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.slice("flat", i * len(cells[0].centre) + 1, F.lit(len(cells[0].centre)))).alias("v"))).alias("x"))
    some = F.pmod(F.xxhash64("x.ids", F.lit(seed)), F.lit(1_000_000)) < int(min(1.0, sample / total) * 1_000_000)
    q = cut(held.where(some).select(F.col("x.ids").alias("query_id"), F.col("x.v").alias("q")))
    truth = search(index, q, k, exact=True)
    rows = truth.join(held.select(F.col("x.ids").alias("id"), "cell"), "id").join(q, "query_id").select("cell", "q").collect()  # k rows for each of the sample
    if not rows:
        return 1
    number = np.array([r.cell for r in cells])
    near = np.argsort(-(_unit(np.array([r.q for r in rows], np.float64)) @ np.array([r.centre for r in cells]).T), axis=1, kind="stable")
    place = (number[near] == np.array([r.cell for r in rows])[:, None]).argmax(axis=1) + 1
    return int(np.sort(place)[min(len(place) - 1, int(np.ceil(target * len(place))) - 1)])


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the rows of ``truth`` (``query_id, id``) that were found."""
    both = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()
    return float(both[0] or 0.0)


def session_index(spark: SparkSession, vectors: DataFrame, width: int, key: str, _kept: dict = {}) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """The index of a table in this session, built once."""
    key = (spark.sparkContext.applicationId, key)
    if key not in _kept:
        _kept[key] = build(vectors, width)
    return _kept[key]
