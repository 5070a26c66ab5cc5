"""Paths of two edges, met in blocks: what nodes reach over their neighbours is a row of bits, not a row for each path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import cut
from .model import KB

#: Edges of a knowledge base that make one block of starts, and one of ends.
BLOCK_EDGES = 1 << 20
#: Bytes that a task may take for the starts it looks at together; one start takes what its block of ends needs.
ROOM = 1 << 22
#: A node that leads to this part of a block's ends, or more, is kept as a row of bits.
SPARSE = 128


def _lists(batches: list[pa.RecordBatch], ends: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one side, where each one's list begins (and the last one ends), and the lists behind one another."""
    sides = [b.column("ends").to_numpy(zero_copy_only=False) == ends for b in batches]
    nodes = [b.column("node").to_numpy()[s] for b, s in zip(batches, sides, strict=True)]
    near = [b.column("near").filter(pa.array(s)) for b, s in zip(batches, sides, strict=True)]
    sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in near]).astype(np.int64)
    return np.concatenate(nodes), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([x.flatten().to_numpy() for x in near])


def _within(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``begin``, ``begin + 1``, ... of each place, ``size`` of them, behind one another."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _bits(rows: int, width: int, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """``rows`` rows of ``width`` bits, of which those at ``row`` and ``column`` are set."""
    out = np.zeros((rows, width), bool)
    out[row, column] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def _meet(batches: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some starts at a time: the starts, the block's ends, and for each start a row of bytes with a bit for each end that it reaches."""
    start, at, mid = _lists(batches, False)
    via, begin, end = _lists(batches, True)
    if not len(mid) or not len(end):
        return
    # In order of their nodes, of which one may have several lists.
    by = np.argsort(via)
    size = np.diff(begin)[by]
    end = end[_within(begin[by], size)]
    via, first = np.unique(via[by], return_index=True)
    begin = np.append((np.cumsum(size) - size)[first], len(end))
    names, column = np.unique(end, return_inverse=True)
    degree = np.diff(begin)
    m = np.searchsorted(via, mid).clip(max=len(via) - 1)
    met = via[m] == mid
    row, m = np.repeat(np.arange(len(start)), np.diff(at))[met], m[met]

    width = -(-len(names) // 64) * 64
    wide = degree * SPARSE >= len(names)
    many, number, step = np.flatnonzero(wide), np.cumsum(wide) - 1, max(1, ROOM // width)
    bits = np.empty((len(many), width // 64), np.uint64)
    for low in range(0, len(many), step):
        k = many[low : low + step]
        bits[low : low + step] = _bits(len(k), width, np.repeat(np.arange(len(k)), degree[k]), column[_within(begin[k], degree[k])])

    cost = width + np.bincount(row, np.where(wide[m], width // 8, 32 * degree[m]), len(start)).astype(np.int64)
    turns = np.flatnonzero(np.diff(np.cumsum(cost) // ROOM)) + 1
    for low, high in zip([0, *turns], [*turns, len(start)], strict=True):
        part = slice(*np.searchsorted(row, [low, high]))
        r, k = row[part] - low, m[part]
        thin, thick = ~wide[k], wide[k]
        reached = _bits(high - low, width, np.repeat(r[thin], degree[k[thin]]), column[_within(begin[k[thin]], degree[k[thin]])])
        rows, first = np.unique(r[thick], return_index=True)
        if len(rows):
            reached[rows] |= np.bitwise_or.reduceat(bits[number[k[thick]]], first, axis=0)
        reached = reached.view(np.uint8)
        # No node is its own pair.
        own = np.searchsorted(names, start[low:high]).clip(max=len(names) - 1)
        here = np.flatnonzero(names[own] == start[low:high])
        reached[here, own[here] >> 3] &= ~(1 << (own[here] & 7)).astype(np.uint8)
        yield start[low:high], names, reached


def _counts(start: np.ndarray, names: np.ndarray, reached: np.ndarray) -> Iterator[dict]:
    n = np.bitwise_count(reached).sum(axis=1, dtype=np.int64)
    yield {"a": start[n > 0], "n": n[n > 0]}


def _pairs(start: np.ndarray, names: np.ndarray, reached: np.ndarray) -> Iterator[dict]:
    step = max(1, ROOM // (64 * len(names)))
    for low in range(0, len(start), step):
        r, c = np.nonzero(np.unpackbits(reached[low : low + step], axis=1, bitorder="little"))
        yield {"a": start[low + r], "b": names[c]}


def _cells(sym: DataFrame) -> DataFrame:
    """``user_id, kb_id, i, j, ends, node, near``: lists of neighbours, by cells of a block of starts and one of ends.

    Edges go both ways, so a node's list is that of a start and that of a neighbour. A start
    stands in one block with its whole list; a neighbour's list is dealt to the blocks of its
    ends, which are as many as the knowledge base's edges ask for.
    """
    # Lists name the node and its knowledge base once, so they take less room in the checkpoint than edges.
    near = cut(sym.select(*KB, "a", "b").repartition("a").groupBy(*KB, "a").agg(F.collect_list("b").alias("near")))
    large = near.groupBy(*KB).agg(F.ceil(F.sum(F.size("near")) / BLOCK_EDGES).cast("int").alias("side")).where("side > 1")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KB]
    # Only knowledge bases of several blocks are sent, one for a million edges at most.
    sided = lambda df: df.alias("s").join(F.broadcast(large).alias("k"), same, "left").select("s.*", F.coalesce("side", F.lit(1)).alias("side"))
    block = lambda c: F.pmod(F.xxhash64(c), "side").cast("int")
    every = F.sequence(F.lit(0), F.col("side") - 1)
    starts = sided(near).select(*KB, block("a").alias("i"), F.explode(every).alias("j"), F.lit(False).alias("ends"), F.col("a").alias("node"), "near")
    # Edges join by id alone, so a node leads on to its neighbours in whatever knowledge base.
    on = sided(near.select(*KB, "a").join(near.select("a", "near"), "a")).select("*", F.explode(every).alias("j"))
    on = on.withColumn("near", F.when(F.col("side") == 1, F.col("near")).otherwise(F.filter("near", lambda c: block(c) == F.col("j")))).where(F.size("near") > 0)
    on = on.select(*KB, F.explode(every).alias("i"), "j", F.lit(True).alias("ends"), F.col("a").alias("node"), "near")
    return starts.unionByName(on)


def _reach(sym: DataFrame, make, columns: str) -> DataFrame:
    """What ``make`` makes of each cell's starts, ends and bits."""

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kb = dict(zip(KB, key, strict=False))
        for some in _meet(list(batches)):
            for made in make(*some):
                size = len(made["a"])
                yield pa.RecordBatch.from_pydict({k: pa.repeat(v.cast(pa.string()), size) for k, v in kb.items()} | {k: pa.array(v) for k, v in made.items()})

    # Cells are small and work hard, so they aren't put together by size.
    cells = _cells(sym).repartition(4 * sym.sparkSession.sparkContext.defaultParallelism, *KB, "i", "j")
    return cells.groupBy(*KB, "i", "j").applyInArrow(cell, f"user_id string, kb_id string, {columns}")


def two_hop(sym: DataFrame) -> DataFrame:
    """Distinct ordered pairs joined by a path of two edges of ``sym``, which go both ways; each is made once, by the cell of its ends."""
    return _reach(sym, _pairs, "a long, b long")


def two_hop_counts(sym: DataFrame) -> DataFrame:
    """``user_id, kb_id, a, n``: to how many other nodes a path of two edges leads, the pairs of :func:`two_hop` by their first node."""
    return _reach(sym, _counts, "a long, n long").groupBy(*KB, "a").agg(F.sum("n").alias("n"))
