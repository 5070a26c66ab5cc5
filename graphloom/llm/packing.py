"""Best-fit packing: tokenized texts into fixed-length sequences, with certified bin counts.

Each partition of the pieces is packed by best-fit decreasing, and a lower bound from
dual feasible functions says whether its number of sequences is the least possible.
Partitions with a gap give up the sequences that aren't full; those pieces are dealt to
fewer partitions and packed again, until one round is certified or a single bounded
partition is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import fold, loads, names, text_of, text_slices
from .storage import materialize

CAPACITY = 4096
END_ID = 1
#: Sequences that a partition of the pieces fills at least.
LEAST_SEQUENCES = 64
#: Words that a Python worker remembers at most; beyond it, it starts anew.
REMEMBERED = 600_000

_LETTER, _DIGIT, _SPACE, _OTHER, _ODD = range(5)
#: Byte classes of the fast path: ASCII, and letters whose UTF-8 form starts with C3.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _OTHER


class Tokenizing:
    """Ids of whole texts, the same as the tokenizer's own, with each distinct word encoded once.

    The vocabulary splits a text into words, digits and runs of other signs and encodes each
    alone, so ids can be kept by word. Texts with characters outside ASCII and U+00C0..U+00FF,
    with an apostrophe (contractions) or with ``<|`` go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocab = self.whole.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            if token.endswith("</w>"):
                self.last[i] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _learn(self, words: list[bytes], texts: list[str]) -> None:
        found = [e.ids for e in self.whole.encode_batch([" ".join(texts[i : i + 500]) for i in range(0, len(texts), 500)], add_special_tokens=False)]
        ids = np.array([x for f in found for x in f], np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(texts):
            raise RuntimeError("a word of the fast path wasn't encoded as one word")
        n, k = len(self.known), len(texts)
        while n + k > len(self.start):
            self.start, self.count = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.count, np.zeros_like(self.count)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        begins = np.concatenate([[0], ends[:-1]])
        self.start[n : n + k], self.count[n : n + k] = begins + self.used, ends - begins
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + k), strict=True))

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        for _, offsets, data in text_slices(column, 1 << 21):
            yield from self._slice(offsets, data)

    def _slice(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
        rows, n = len(offsets) - 1, len(data)
        if not n:
            yield from [np.zeros(0, np.uint32)] * rows
            return
        kind = _KIND[data]
        odd = kind == _ODD
        odd |= data == 0x27
        high = data >= 0x80
        after = np.concatenate([[False], data[:-1] == 0xC3])
        odd |= high & (data < 0xC0) & ~after
        odd |= after & ((data == 0x97) | (data == 0xB7))
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        slow = np.zeros(rows, bool)
        slow[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        if slow.any():
            keep = np.repeat(~slow, np.diff(offsets))
            sizes = np.where(slow, 0, np.diff(offsets))
            quick = self._quick(np.concatenate([[0], np.cumsum(sizes)]), data[keep])
        else:
            quick = self._quick(offsets, data)
        for i, ids in enumerate(quick):
            if slow[i]:
                text = text_of(data[offsets[i] : offsets[i + 1]].tobytes())
                ids = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
            yield ids

    @staticmethod
    def _compare(data: np.ndarray, start: np.ndarray, end: np.ndarray, same: np.ndarray) -> None:
        """Compare each word of more than eight bytes (names of others are one-to-one) with the first one of its name."""
        size = end - start
        at = np.flatnonzero((size > 8) & (same != np.arange(len(size))))
        if (size[at] != size[same[at]]).any():
            raise RuntimeError("two words share a name")
        eight, step = loads(data), 0
        while len(at):
            one, two = start[at] + np.minimum(step, size[at] - 8), start[same[at]] + np.minimum(step, size[at] - 8)
            if (eight[one] != eight[two]).any():
                raise RuntimeError("two words share a name")
            step += 8
            at = at[size[at] > step]

    def _quick(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
        rows, n = len(offsets) - 1, len(data)
        if not n:
            return iter([np.zeros(0, np.uint32)] * rows)
        offsets, data = fold(offsets, data)
        kind = _KIND[data]
        edge = np.empty(n, bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == _DIGIT
        edge[offsets[:-1][offsets[:-1] < n]] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], n)
        word = kind[start] != _SPACE
        start, end = start[word], end[word]
        _, at, inverse = np.unique(names(data, start, end), return_index=True, return_inverse=True)
        self._compare(data, start, end, at[inverse])
        raw = data.tobytes()
        unique = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        if len(self.known) + len(unique) > REMEMBERED:
            self.forget()
        get = self.known.get
        where = np.array([get(u, -1) for u in unique], np.int64)
        new = np.flatnonzero(where < 0)
        if len(new):
            words = [unique[i] for i in new.tolist()]
            self._learn(words, [w.decode() for w in words])
            where[new] = np.arange(len(self.known) - len(new), len(self.known))
        entry = where[inverse]
        counts = self.count[entry].astype(np.int64)
        stop = np.cumsum(counts)
        ids = self.ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.start[entry] - (stop - counts), counts)]
        bounds = np.concatenate([[0], stop])[np.searchsorted(start, offsets)]
        return iter([ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])


_tokenizers: dict[str, Tokenizing] = {}


def _tokenizing(name: str) -> Tokenizing:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers

    path = public_tokenizers.path(name)
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizing(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and the end id, cut only where longer than ``capacity``.

    A null or empty text is the end id alone. Repeated rows give repeated pieces. Bytes that
    aren't UTF-8 count as U+FFFD. A text is held whole by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizing(tokenizer)
        tail = np.array([END_ID], np.uint32)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tok.rows(batch.column(1))):
                ids = np.concatenate([ids, tail])
                for k, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s : s + capacity]
                    row.append(i), piece.append(k), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The least number of bins by dual feasible functions.

    For each k, an item above capacity-k counts as a whole bin, one of size k to capacity-k
    by its size and a smaller one as nothing; for each step count m, size x counts as
    ``floor((m+1) x / capacity) / m`` unless that product is whole, then as ``x / capacity``.
    The sum of any such function over the items is a lower bound, and the largest is returned.
    """
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """:func:`lower_bound` of so many items of each length from 0 to ``capacity``."""
    count = count.astype(np.float64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    many, mass = np.cumsum(count), np.cumsum(count * size)
    k = np.arange(1, capacity // 2 + 1)
    whole = many[-1] - many[capacity - k]
    middle = mass[capacity - k] - mass[k - 1]
    best = max(best, int(np.ceil((whole + middle / capacity).max() - 1e-9)))
    for m in range(1, 21):
        scaled = (m + 1) * size
        f = np.where(scaled % capacity == 0, size / capacity, scaled // capacity / m)
        best = max(best, int(np.ceil((f * count).sum() - 1e-9)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each item: largest items first, each into the fullest bin with room for it."""
    bins = np.empty(len(sizes), np.int64)
    rooms: list[int] = []  # the distinct free spaces, ascending
    by_room: dict[int, list[int]] = {}
    used = 0
    values = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        need = values[i]
        k = bisect_left(rooms, need)
        if k == len(rooms):
            b, room = used, capacity
            used += 1
        else:
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[k]
        bins[i] = b
        if left := room - need:
            if left in by_room:
                by_room[left].append(b)
            else:
                by_room[left] = [b]
                insort(rooms, left)
    return bins


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = 50_000, max_rounds: int = 12) -> DataFrame:
    """``items`` (with ``length``) and ``sequence_id, offset``: a place for every item, gapless from 0 in each sequence.

    Items of full length are sequences of their own. The others are dealt by hash to
    partitions of about ``per_partition`` items. A round packs every partition; the full
    sequences of one whose count equals its lower bound are certified and stay, and its
    least full sequence joins the exchange, so that partitions leave no open sequence each.
    Partitions with a gap keep the sequences with at most 1/1024 of their room free and give
    up the rest. What is given up is dealt anew to fewer partitions; the last round keeps
    everything. Items of equal length are packed in the order of their rows. An empty input
    gives an empty result. :func:`certificate` compares the result with the least number.
    """
    items = materialize(items.withColumn("_id", F.monotonically_increasing_id()), "pieces")
    schema = "round int, part long, bin long, _id long, offset long, left boolean"

    def packing(number: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            ids, sizes = table.column("_id").to_numpy(), table.column("length").to_numpy()
            order = np.argsort(ids)
            ids, sizes = ids[order], sizes[order]
            bins = best_fit_decreasing(sizes, capacity)
            n, bound = int(bins.max()) + 1, lower_bound(sizes, capacity)
            fill = np.bincount(bins, weights=sizes).astype(np.int64)
            if last:
                open_ = np.zeros(n, bool)
            elif n == bound:
                open_ = (np.arange(n) == fill.argmin()) & (fill < capacity)
            else:
                open_ = capacity - fill > capacity // 1024
            order = np.argsort(bins, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            first = np.r_[True, bins[order][1:] != bins[order][:-1]]
            offset = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(ids))))
            k = len(ids)
            return pa.table({"round": pa.array(np.full(k, number, np.int32)), "part": pa.array(np.full(k, part, np.int64)), "bin": pa.array(bins[order]), "_id": pa.array(ids[order]), "offset": pa.array(offset), "left": pa.array(open_[bins[order]])})

        return run

    full = items.where(F.col("length") == capacity).select(F.lit(-1).alias("round"), F.lit(0).cast("long").alias("part"), F.col("_id").alias("bin"), "_id", F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("_id", "length")
    done, number, before = [full], 0, None
    while True:
        n, tokens = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not n:
            break
        # A partition has some sequences at least, as each may leave one open.
        parts = max(1, min(-(-n // per_partition), int(tokens) // (LEAST_SEQUENCES * capacity)))
        # A single partition, or exchanges that hardly free anything any more, make the last round.
        last = parts == 1 or number + 1 >= max_rounds or (before is not None and n > 0.9 * before)
        before = n
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("_id", F.lit(number)), F.lit(parts)))
        packed = materialize(dealt.groupBy("part").applyInArrow(packing(number, last), schema), "packed")
        done.append(packed.where("not left").select("round", "part", "bin", "_id", "offset"))
        if last:
            break
        rest = packed.where("left").join(items.select("_id", "length"), "_id").select("_id", "length")
        number += 1
    places = done[0]
    for d in done[1:]:
        places = places.unionByName(d)
    places = places.select("_id", "round", "part", "bin", "offset")
    # A dense code of (round, part, bin): bins of a partition are below its item count, rounds and partitions are few.
    code = F.col("bin") + F.when(F.col("round") < 0, F.lit(0)).otherwise((F.col("round") + 1) * F.lit(1 << 56) + F.col("part") * F.lit(1 << 28))
    places = places.select("_id", code.alias("sequence_id"), "offset")
    return items.join(places, "_id").drop("_id")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """``(sequences, least possible number)`` of a packing; the bound covers all items and is made from counts by length."""
    counts = {r[0]: r[1] for r in packed.groupBy("length").count().collect()}  # one row a length
    total = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        total[size] = n
    return packed.select("sequence_id").distinct().count(), bound_of_counts(total, capacity)
