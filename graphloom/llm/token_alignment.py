"""Alignment of two vocabularies: which ids of one stand where ids of the other do.

Both encode the same bytes; wherever tokens of both end together, a group ends. All pairs
of ids within a group are links. Links are dealt out in stripes of first ids, so that one
stripe's counts are a dense matrix of bounded size, however large the corpus is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import text_slices
from .storage import discard, materialize
from .word_tokens import ByteLevel, Pieces, public_path, spread, valid, vocabulary

#: Stripes of first ids; id ``a`` is row ``a // STRIPES`` of stripe ``a % STRIPES``.
STRIPES = 512
#: Bytes of text whose links lie in one row a stripe.
CHUNK = 1 << 20
#: Links that are counted together before they are shuffled, and that one task scores of a stripe.
HELD, SCORED = 4_000_000, 4_000_000
#: Groups of more pairs are taken apart into distinct ids first.
WIDE = 64
_B = 1 << 16  # second ids are below

class _Bytes:
    """What the ids of a vocabulary stand for, as one array."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.start[ids], self.size[ids])]


class Aligner:
    """Both vocabularies in a worker."""

    def __init__(self, a: str, b: str):
        self.a, self.b = vocabulary(ByteLevel, public_path(a), False), vocabulary(Pieces, public_path(b))
        self.bytes_a, self.bytes_b = _Bytes(self.a.token_bytes()), _Bytes(self.b.token_bytes())
        # How an id is written within a group and at the end of its side: 2 * id and 2 * id + 1, the second side's behind the first's.
        sides = ((len(self.bytes_a.size), b"|"), (len(self.bytes_b.size), b";"))
        self.written = [b"%d%b" % (i, sign) for n, last in sides for i in range(n) for sign in (b",", last)]

    def slice(self, offsets: np.ndarray, data: np.ndarray) -> tuple[dict[str, np.ndarray | list], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(columns of the documents, (document, pair, links))`` of texts that have their space already; pairs are ``a * 2**16 + b``, once a document."""
        rows = len(offsets) - 1
        a, at_a = self.a.slice(offsets, data)
        b, at_b = self.b.slice(offsets, data)
        # Both must give back the bytes; a text that is only the space is empty.
        fine = np.diff(offsets) > 1
        for own, ids, at in ((self.bytes_a, a, at_a), (self.bytes_b, b, at_b)):
            size = np.concatenate([[0], np.cumsum(own.size[ids])])[at]
            fine &= np.diff(size) == np.diff(offsets)
            if fine.all() and len(data):
                wrong = np.flatnonzero(own.joined(ids) != data)
                fine[np.searchsorted(offsets, wrong, "right") - 1] = False
            else:
                joined = own.joined(ids)
                for i in np.flatnonzero(fine).tolist():
                    fine[i] = np.array_equal(joined[size[i] : size[i + 1]], data[offsets[i] : offsets[i + 1]])
        if not fine.all():
            a, at_a = a[np.repeat(fine, np.diff(at_a))], np.concatenate([[0], np.cumsum(np.where(fine, np.diff(at_a), 0))])
            b, at_b = b[np.repeat(fine, np.diff(at_b))], np.concatenate([[0], np.cumsum(np.where(fine, np.diff(at_b), 0))])
        end_a, end_b = np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b])
        where = np.minimum(np.searchsorted(end_b, end_a), max(len(end_b) - 1, 0))
        both = np.flatnonzero(end_b[where] == end_a) if len(b) else np.zeros(0, np.int64)
        # Groups: tokens of either side up to and with each common end. Documents end together, so no group spans two.
        last_a, last_b = both, where[both]
        first_a, first_b = np.concatenate([[0], last_a[:-1] + 1])[: len(both)], np.concatenate([[0], last_b[:-1] + 1])[: len(both)]
        n_a, n_b = last_a - first_a + 1, last_b - first_b + 1
        group = np.searchsorted(last_a, at_a)  # first group of each document
        links = np.concatenate([[0], np.cumsum(n_a * n_b)])
        document = np.repeat(np.arange(rows), np.diff(group))
        columns = {"n_a": np.diff(at_a), "n_b": np.diff(at_b), "n_groups": np.diff(group), "n_links": np.diff(links[group]), "groups_sha256": self._digests(a, b, at_a, at_b, last_a, last_b, n_a, n_b)}
        return columns, self._pairs(a, b, document, first_a, first_b, n_a, n_b)

    def _digests(self, a, b, at_a, at_b, last_a, last_b, n_a, n_b) -> list[str]:
        # Both sides' tokens in the order of the text: a group's first side, then its second.
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[last_a], ends_b[last_b] = 1, 1
        place_a = np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)
        place_b = np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)
        mixed = np.empty(len(a) + len(b), np.int64)
        mixed[place_a] = 2 * a.astype(np.int64) + ends_a
        mixed[place_b] = 2 * (b.astype(np.int64) + len(self.bytes_a.size)) + ends_b
        get, out = self.written.__getitem__, []
        for i, j in zip((at_a + at_b)[:-1].tolist(), (at_a + at_b)[1:].tolist(), strict=True):
            out.append(hashlib.sha256(b"".join(map(get, mixed[i:j].tolist()))[:-1]).hexdigest() if j > i else "")
        return out

    @staticmethod
    def _pairs(a, b, document, first_a, first_b, n_a, n_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = n_a * n_b
        few = np.flatnonzero(size <= WIDE)
        k = spread(np.zeros(len(few), np.int64), size[few])
        of = np.repeat(few, size[few])
        width = n_b[of]
        row = k // width
        key = (a[first_a[of] + row].astype(np.int64) << 16) | b[first_b[of] + k - row * width]
        docs, keys, times = [document[of]], [key], [np.ones(len(key), np.int64)]
        for g in np.flatnonzero(size > WIDE).tolist():
            ua, ca = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            ub, cb = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            keys.append(((ua.astype(np.int64) << 16)[:, None] | ub[None, :].astype(np.int64)).ravel())
            docs.append(np.full(len(keys[-1]), document[g])), times.append((ca[:, None] * cb[None, :]).ravel())
        doc, key, n = np.concatenate(docs), np.concatenate(keys), np.concatenate(times)
        both = (doc.astype(np.int64) << 32) | key
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        return both[first] >> 32, both[first] & 0xFFFFFFFF, np.add.reduceat(n[order], first) if len(first) else n[order]


_kept: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _kept:
        _kept[a, b] = Aligner(a, b)
    return _kept[a, b]


def _stripes(doc: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """``(stripe, links, block)``: cell of the stripe's matrix, document and number of links of each pair, by stripe and cell."""
    a, b = key >> 16, key & (_B - 1)
    stripe, cell = a % STRIPES, (a // STRIPES) * _B + b
    order = np.lexsort((doc, (stripe << 32) | cell)) if len(key) else np.zeros(0, np.int64)
    stripe, cell, doc, n = stripe[order], cell[order].astype("<u4"), doc[order].astype("<u4"), n[order].astype("<u8")
    first = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]])) if len(key) else np.zeros(0, np.int64)
    for i, j in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
        yield int(stripe[i]), j - i, cell[i:j].tobytes() + doc[i:j].tobytes() + n[i:j].tobytes()


def _unpacked(n: int, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<u4", n, 4 * n), np.frombuffer(raw, "<i8", n, 8 * n)


def _encoded(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of two kinds: one for each document (``place`` in its chunk), and one for each stripe of a chunk that has links."""
    kind = docs.schema["doc_id"].dataType
    schema = f"kind int, chunk long, place int, doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, links int, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk = _aligner(a, b), TaskContext.get().partitionId() << 32
        for batch in batches:
            text = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(batch.column(1), "").cast(pa.large_string()), pa.scalar("", pa.large_string()))
            for row, offsets, data in text_slices(text, CHUNK):
                found, pairs = own.slice(*valid(offsets, data))
                k = len(offsets) - 1
                null = lambda t, n=k: pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(k, np.int32)), pa.array(np.full(k, chunk)), pa.array(np.arange(k, dtype=np.int32)), batch.column(0).slice(row, k), *(pa.array(found[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(found["groups_sha256"]), null(pa.int32()), null(pa.int32()), null(pa.binary())],
                    names=names,
                )
                for held in _batched(_stripes(*pairs), 64):
                    k = len(held)
                    null = lambda t, n=k: pa.nulls(n, t)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ones(k, np.int32)), pa.array(np.full(k, chunk)), null(pa.int32()), pa.nulls(k, batch.schema.field(0).type), *(null(pa.int64()) for _ in range(4)), null(pa.string()), pa.array([h[0] for h in held], pa.int32()), pa.array([h[1] for h in held], pa.int32()), pa.array([h[2] for h in held], pa.binary())],
                        names=names,
                    )
                chunk += 1

    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _batched(items: Iterator, n: int) -> Iterator[list]:
    held = []
    for x in items:
        held.append(x)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def _counts(links: DataFrame) -> DataFrame:
    """``stripe, cells, block``: the documents of each pair. Tasks count what they hold of a stripe before it is shuffled; a stripe's sums are added into its dense matrix, which then goes row by row."""

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part in _batched(iter(held.items()), 64):
                out = [np.unique(np.concatenate(cells), return_counts=True) for _, cells in part]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in part], pa.int32()), pa.array([len(c) for c, _ in out], pa.int32()), pa.array([c.tobytes() + n.astype("<i8").tobytes() for c, n in out], pa.binary())], names=["stripe", "cells", "block"])

        for batch in batches:
            for stripe, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(stripe, []).append(np.frombuffer(raw, "<u4", n))
                size += n
            if size >= HELD:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, matrix = None, None

        def rows() -> Iterator[pa.RecordBatch]:
            cell = np.flatnonzero(matrix)
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(cell)], pa.int32()), pa.array([cell.astype("<u4").tobytes() + matrix[cell].astype("<i8").tobytes()], pa.binary())], names=["stripe", "cells", "block"])

        for batch in batches:
            for stripe, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stripe != now:
                    if matrix is not None:
                        yield from rows()
                    now, matrix = stripe, np.zeros(0, np.int64)
                cell, count = np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<i8", n, 4 * n)
                if n and cell[-1] >= len(matrix):
                    matrix = np.concatenate([matrix, np.zeros((int(cell[-1]) // _B + 1) * _B - len(matrix), np.int64)])
                np.add.at(matrix, cell, count)
        if matrix is not None:
            yield from rows()

    schema = "stripe int, cells int, block binary"
    part = links.select("stripe", "links", "block").mapInArrow(before, schema)
    return part.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(summed, schema)


def _scored(links: DataFrame, counts: DataFrame) -> DataFrame:
    """``chunk, docs, block``: of each stripe of a chunk, the documents with their best links and the sum over their links.

    Links meet the counts of their stripe; one with many links is dealt to several tasks,
    each of which gets its counts.
    """
    size = {r.stripe: r.n for r in links.groupBy("stripe").agg(F.sum("links").alias("n")).collect()}  # a row a stripe
    parts = [max(1, -(-size.get(s, 0) // SCORED)) for s in range(STRIPES)]
    many = F.array(*map(F.lit, parts))[F.col("stripe")]
    dealt = links.select("stripe", F.pmod(F.xxhash64("chunk"), many).cast("int").alias("part"), F.lit(1).alias("kind"), "chunk", F.col("links").alias("n"), "block")
    known = counts.select("stripe", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), F.col("cells").alias("n"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = best = None
        for batch in batches:
            out = []
            for kind, chunk, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    cell = np.frombuffer(raw, "<u4", n)
                    matrix = np.zeros((int(cell[-1]) // _B + 1, _B), np.int64)
                    np.add.at(matrix.reshape(-1), cell, np.frombuffer(raw, "<i8", n, 4 * n))
                    best = matrix.max(axis=1)
                    matrix = matrix.reshape(-1)
                else:
                    cell, doc, times = _unpacked(n, raw)
                    count = matrix[cell]
                    docs, at = np.unique(doc, return_inverse=True)
                    n_best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                    np.add.at(n_best, at, times * (count == best[cell // _B]))
                    np.add.at(total, at, times * count)
                    out.append((chunk, len(docs), docs.astype("<u4").tobytes() + n_best.astype("<i8").tobytes() + total.astype("<i8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["chunk", "docs", "block"])

    both = dealt.unionByName(known).repartition("stripe", "part").sortWithinPartitions("stripe", "part", "kind")
    return both.select("kind", "chunk", "n", "block").mapInArrow(run, "chunk long, docs int, block binary")


def _totals(scores: DataFrame) -> DataFrame:
    """``chunk, place, n_best, count_sum``: the stripes of each chunk put together, of which there are no more than ``STRIPES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, total = None, None, None

        def rows() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now, np.int64)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], names=["chunk", "place", "n_best", "count_sum"])

        for batch in batches:
            for chunk, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    if now is not None:
                        yield from rows()
                    now, best, total = chunk, np.zeros(0, np.int64), np.zeros(0, np.int64)
                doc = np.frombuffer(raw, "<u4", n)
                if n and doc[-1] >= len(total):
                    more = np.zeros(int(doc[-1]) + 1 - len(total), np.int64)
                    best, total = np.concatenate([best, more]), np.concatenate([total, more])
                best[doc] += np.frombuffer(raw, "<i8", n, 4 * n)
                total[doc] += np.frombuffer(raw, "<i8", n, 12 * n)
        if now is not None:
            yield from rows()

    return scores.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "chunk long, place int, n_best long, count_sum long")


def pair_counts(counts: DataFrame) -> DataFrame:
    """``a, b, n_docs, best`` from the counts of :func:`align`: every linked pair of ids, in how many documents it is linked, and whether no other id is linked with ``a`` more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cell, count = np.frombuffer(raw, "<u4", n).astype(np.int64), np.frombuffer(raw, "<i8", n, 4 * n)
                row = cell // _B
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if n else np.zeros(0, np.int64)
                most = np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, n))) if n else count
                yield pa.RecordBatch.from_arrays([pa.array(row * STRIPES + stripe), pa.array(cell % _B), pa.array(count), pa.array(count == most)], names=["a", "b", "n_docs", "best"])

    return counts.select("stripe", "cells", "block").mapInArrow(run, "a long, b long, n_docs long, best boolean")


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[DataFrame, DataFrame]:
    """``(documents, counts)`` of the vocabularies ``a`` (byte-level) and ``b`` (pieces with a space before each text).

    Documents: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, a row
    each. A text that is null, empty, or whose bytes one side doesn't give back has no tokens:
    zeros and an empty digest. Bytes that aren't UTF-8 count as U+FFFD. Strings of special
    tokens in a text are plain text. Repeated rows are documents of their own. :func:`pair_counts`
    lists the counts.

    A chunk of texts (1 MiB, or one longer text) is held by one task with its pairs, some
    sixty bytes a byte; a group without common ends is taken as distinct ids with their
    numbers. The driver gets one number for each of the 512 stripes.
    """
    table = materialize(_encoded(docs, a, b), "aligned")
    links = table.where("kind = 1")
    counts = materialize(_counts(links), "counts")
    scores = materialize(_totals(_scored(links, counts)), "scores")
    docs_ = table.where("kind = 0").select("chunk", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    out = docs_.join(scores, ["chunk", "place"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    result = materialize(out, "alignment")
    discard(table)
    discard(scores)
    return result, counts
