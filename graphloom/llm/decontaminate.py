"""Benchmark decontamination by pigeonhole edit matching over words.

A test item of m words with an error budget of e word edits is split into e+1 pieces; a
passage within the budget holds at least one piece unchanged. Piece hits are found by
hashed word runs, and the passage around a hit is verified by Myers' bit-parallel
distance between the item's words and any stretch of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, fold, mix, text_slices, words

ERROR_SHARE = 0.15
LEAST_PIECE = 4
#: Bytes of test items that are held at a time; longer lists are matched block by block.
BLOCK_BYTES = 8 << 20
_STEP = U64(0xD6E8FEB86659FD93)


def budget(m: int) -> int:
    """Word edits allowed in an item of m words: 15 %, as long as every piece keeps four words."""
    return max(0, min(int(ERROR_SHARE * m), m // LEAST_PIECE - 1))


def best_end(pattern: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """``(distance, end)`` of the stretch of ``text`` nearest to ``pattern`` (Myers 1999); None above ``most``. Ties: first end."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def longest_start(pattern: list[int], text: list[int], distance: int) -> int:
    """How many words at the start of ``text`` are ``distance`` edits from ``pattern``, the most alike in number."""
    row = list(range(len(text) + 1))
    for i, w in enumerate(pattern):
        new = [i + 1]
        for j, v in enumerate(text):
            new.append(min(row[j] + (w != v), row[j + 1] + 1, new[j] + 1))
        row = new
    return min((abs(j - len(pattern)), j) for j, d in enumerate(row) if d == distance)[1]


class Items:
    """One block of test items with its piece index."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.most = [], [], []
        pieces: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item, text in rows:
            column = pa.array([text])
            _, offsets, data = next(text_slices(column))
            h, _, _ = words(*fold(offsets, data))
            m = len(h)
            if not m:
                continue
            e = budget(m)
            k = len(self.ids)
            self.ids.append(item), self.words.append(h.tolist()), self.most.append(e)
            cuts = [m * i // (e + 1) for i in range(e + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                g = h[a : a + 1].copy()
                for j in range(a + 1, b):
                    g = g * _STEP + h[j : j + 1]
                pieces.setdefault((b - a, int(mix(g)[0])), []).append((k, a))
        self.pieces = pieces
        self.by_size = {}
        for size in sorted({s for s, _ in pieces}):
            keys = np.array(sorted(x for s, x in pieces if s == size), U64)
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> U64(44)).astype(np.int64)] = True
            self.by_size[size] = (keys, seen)

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """``(row, item, distance, first word, end word)``: for each row and item the best passage, ties to the first."""
        if not self.by_size:
            return
        for row0, offsets, data in text_slices(column):
            h, _, first = words(*fold(offsets, data))
            g, found = h.copy(), []
            for size in range(1, max(self.by_size) + 1):
                if size > 1:
                    if len(h) < size:
                        break
                    g = g[: len(h) - size + 1] * _STEP
                    g += h[size - 1 :]
                if size in self.by_size:
                    keys, seen = self.by_size[size]
                    x = mix(g)
                    at = np.flatnonzero(seen[(x >> U64(44)).astype(np.int64)])
                    x = x[at]
                    ok = keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x
                    found += [(p, size, v) for p, v in zip(at[ok].tolist(), x[ok].tolist(), strict=True)]
            rows = np.searchsorted(first, [p for p, _, _ in found], "right") - 1
            starts: dict[tuple[int, int], set[int]] = {}
            for (p, size, v), r in zip(found, rows.tolist(), strict=True):
                if p + size <= first[r + 1]:
                    for k, a in self.pieces[size, v]:
                        starts.setdefault((r, k), set()).add(p - a)
            for (r, k), near in sorted(starts.items()):
                best, upto = None, -1
                m, e = len(self.words[k]), self.most[k]
                for s in sorted(near):
                    lo, hi = max(int(first[r]), s - e), min(int(first[r + 1]), s + m + e)
                    if hi <= upto:
                        continue
                    upto = hi
                    hit = best_end(self.words[k], h[lo:hi].tolist(), e)
                    if hit and (best is None or hit[0] < best[0]):
                        best = (hit[0], lo + hit[1])
                if best:
                    # Backwards from the end, the passage's first word.
                    back = h[max(int(first[r]), best[1] - m - e) : best[1]][::-1].tolist()
                    start = best[1] - longest_start(self.words[k][::-1], back, best[0])
                    yield row0 + r, self.ids[k], best[0], start - int(first[r]), best[1] - int(first[r])


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, distance, word_start, word_end`` for every text that holds a test item within its budget.

    Words are lower-cased runs of letters and digits, so case, spacing and punctuation don't
    count. Items of up to seven words must stand unchanged; items without words match nothing,
    and neither do null texts. Of equally near passages the one that ends first is given.
    Repeated rows of either table give repeated results. A text is held whole by one task. The items stream to the driver and are
    matched against all texts in blocks of at most ``block_bytes``.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, word_start int, word_end int"
    out, block, held = None, [], 0

    def match(rows: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value)
            for batch in batches:
                got = list(zip(*items.matches(batch.column(1)), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(got[0], pa.int64())), pa.array(got[1], items_type), *(pa.array(x, pa.int32()) for x in got[2:])],
                    names=["doc_id", "item_id", "distance", "word_start", "word_end"],
                )

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    items_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
    for item, text in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        block.append((item, text))
        held += len(text)
        if held >= block_bytes:
            out = match(block) if out is None else out.unionByName(match(block))
            block, held = [], 0
    if block or out is None:
        out = match(block) if out is None else out.unionByName(match(block))
    return out
