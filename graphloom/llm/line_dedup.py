"""Line dedup: an edit-distance join by segment partition, over all distinct lines.

A line of ``LEAST_BYTES`` bytes or more is split into ``edits + 1`` even segments; a line
within the distance holds at least one of them unchanged, near its place. Each line's
segments are indexed by line length, segment number and hash. Each line also probes the
index of every length from its own down to ``edits`` less, only at the starting places
that an alignment within the distance allows. Lines that meet at a key are verified by
bit-parallel edit distance on a diagonal band, for all pairs of a batch at once.
Shorter lines are compared for equality alone.

From ``share * (edits + 1)`` bytes on, the distance grows to one edit in ``share`` bytes of
the longer line. Its ``budget + 1`` segments then have at least ``run_bytes`` bytes each, and
one of them stands unchanged in the other line, so that both select the same gram there: the
smallest by hash of a window of that many bytes. The longer line indexes one gram a segment,
every line probes with the grams of the windows where an alignment within the budget can put
a segment of a line of its own length or of one that is longer by the budget at most. Keys
also hold a class of the length and the place in the line.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import packed
from .components import connected_components
from .kernels import _STEP, _STEP_INV, BYTE_VALUE, U64, Unions, mix, powers, text_slices
from .storage import discard, materialize

EDITS = 2
#: Lines of ``SHARE * (EDITS + 1)`` bytes or more may differ by one edit in so many bytes.
SHARE = 50
#: Bytes of a gram that names a window of a long line.
GRAM = 12
#: The keys are dealt and compared in parts by the length of their lines, of this share of all bytes of lines each, so that their shuffle files don't lie on disk all at once.
PART_SHARE = 1.0
LEAST_BYTES = 24
#: Lines that meet at one key in one task; keys with more are cut into blocks that meet two by two.
BLOCK = 512
#: A key whose rows make more pairs of like sizes isn't thinned out by byte counts; its blocks are compared whole.
THINNED = 50_000_000
#: Groups of bytes that are counted, and bits of each count.
GROUPS, BITS = 10, 6
_GROUP = np.arange(256) * 7 % GROUPS
for _i, _letters in enumerate([b" eE", b"tTaA", b"oOiI", b"nNsS", b"rRhH", b"lLdDuU", b"cCmM", b"pPgGfF", b"bByYvV", b"wWkK0123456789"]):
    _GROUP[list(_letters)] = _i
_COUNTED = U64(1) << (U64(BITS) * _GROUP.astype(U64))
#: Keys carry a line's role, its size (or the largest number) and the counts of fewer groups in one word.
SIZE_BITS, KEY_GROUPS = 21, 7
_KEY_COUNTED = U64(1) << (U64(SIZE_BITS + 1) + U64(BITS) * np.array([0, 1, 2, 3, 4, 5, 6, 6, 5, 4], U64)[_GROUP])
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def segments(size: int, edits: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the ``edits + 1`` segments: the first ones are the shorter, by one byte at most."""
    k = edits + 1
    short, longer = size // k, size % k
    out, at = [], 0
    for i in range(k):
        n = short + (i >= k - longer)
        out.append((at, n))
        at += n
    return out


def probes(size: int, edits: int) -> list[tuple[int, int, int, int]]:
    """``(indexed size, segment, start, length)`` of the substrings that a line of ``size`` bytes looks up, multi-match aware."""
    out = []
    for other in range(max(0, size - edits), size + 1):
        diff = size - other
        for i, (p, n) in enumerate(segments(other, edits)):
            # Left: at most i edits before segment i. Right: at most edits - i after it.
            lo = max(0, p - i, p + diff - (edits - i))
            hi = min(size - n, p + i, p + diff + (edits - i))
            out += [(other, i, q, n) for q in range(lo, hi + 1)]
    return out


def line_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row, number in its row)`` of the lines of each text; a text of n breaks has n + 1 lines."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # A break that ends a row starts a line at that row's end, before the next row's own start.
    row_of_break = np.searchsorted(offsets, breaks, "right") - 1
    rows = np.sort(np.concatenate([np.arange(len(offsets) - 1), row_of_break]), kind="stable")
    first = np.searchsorted(rows, np.arange(len(offsets) - 1))
    number = np.arange(len(rows)) - first[rows]
    order = np.lexsort((np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([np.arange(len(offsets) - 1), row_of_break])))
    start = np.concatenate([offsets[:-1], breaks + 1])[order]
    end = np.append(start[1:] - 1, 0)
    last = np.append(rows[1:] != rows[:-1], True)
    end[last] = offsets[1:][rows[last]]
    return start, end, rows, number


def line_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit XXH3 of each line."""
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), U64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _fingerprint_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers that give a 64-bit fingerprint of any stretch; it only proposes candidates."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * powers(_STEP, len(data)), out=total[1:])
    return total, powers(_STEP_INV, len(data) + 1)


def byte_counts(data: np.ndarray, start: np.ndarray, end: np.ndarray, counted: np.ndarray = _COUNTED) -> np.ndarray:
    """The bytes of ten groups in each line, as one sum with six bits a group (modulo 2**64)."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(counted[data], out=total[1:])
    return total[end] - total[start]


def counts_apart(one: np.ndarray, two: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A lower bound of the edits between lines with these byte counts.

    An edit moves one count up, one down, or both. Differences below 32 are read exactly
    from the difference of the sums; others may seem smaller, never the other way round
    for lines whose counts all differ by less.
    """
    d = (one - two).view(np.int64)
    more, less = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
    half = 1 << (BITS - 1)
    for _ in range(groups):
        digit = ((d + half) & ((1 << BITS) - 1)) - half
        more += np.maximum(digit, 0)
        less += np.maximum(-digit, 0)
        d = (d - digit) >> BITS
    return np.maximum(more, less)


_PLACE_KINDS = (U64, U64, np.int64, np.int64, np.int64, np.int64, np.int32, np.int8)
#: Lines that a task combines before they are shuffled.
COMBINED = 500_000


def line_places(docs: DataFrame, buckets: int) -> DataFrame:
    """``doc, body, line, h1, h2, size, blank, first, copies`` of every line; ``(h1, h2)`` names its bytes.

    ``body`` is a hash of the text, which tells texts of one id apart. ``first`` tells the
    first place of each distinct line in the order of doc, body and line; that
    row counts the places of the line. The lines of a task are combined before the shuffle,
    so that a line that stands everywhere comes once from each task.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h1, h2, doc, body, line, size, blank = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            first, copies = _firsts(h1, h2, doc, body, line, np.ones(len(h1), np.int64))
            # Later places needn't meet; they are dealt by place.
            key = np.where(first, h1, mix(body.view(U64) + line.view(U64)))
            yield from packed.pack([h1, h2, doc, body, line, copies, size, (blank + 2 * ~first).astype(np.int8)], buckets, key)

        for batch in batches:
            doc, body = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row0, offsets, data in text_slices(batch.column(2)):
                start, end, row, number = line_bounds(offsets, data)
                inked = np.r_[0, np.cumsum(~_SPACE[data])]
                held.append([*line_names(data, start, end), doc[row0 + row], body[row0 + row], number.astype(np.int64), (end - start).astype(np.int32), inked[end] == inked[start]])
                if sum(len(h[0]) for h in held) >= COMBINED:
                    yield from flush()
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h1, h2, doc, body, line, copies, size, flags in packed.gather(batches, _PLACE_KINDS):
            sent = np.flatnonzero(flags < 2)
            first, total = np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
            first[sent], total[sent] = _firsts(h1[sent], h2[sent], doc[sent], body[sent], line[sent], copies[sent])
            for a in range(0, len(h1), 100_000):
                s = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[s]), pa.array(body[s]), pa.array(line[s].astype(np.int32)), pa.array(h1[s].view(np.int64)), pa.array(h2[s].view(np.int64)), pa.array(size[s]), pa.array(flags[s] & 1 > 0), pa.array(first[s]), pa.array(total[s])],
                    names=["doc", "body", "line", "h1", "h2", "size", "blank", "first", "copies"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(split, packed.SCHEMA).repartition("bucket")
    return rows.mapInArrow(meet, "doc long, body long, line int, h1 long, h2 long, size int, blank boolean, first boolean, copies long")


def _firsts(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, body: np.ndarray, line: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(is the first place of its line, places of the line at its first place)``."""
    first, total = np.ones(len(h1), bool), copies.copy()
    order = np.argsort(h1)
    same = np.zeros(len(h1) + 1, bool)
    same[1:-1] = h1[order][1:] == h1[order][:-1]
    rows = order[same[1:] | same[:-1]]
    if len(rows):
        rows = rows[np.lexsort((line[rows], body[rows], doc[rows], h2[rows], h1[rows]))]
        new = np.r_[True, (h1[rows][1:] != h1[rows][:-1]) | (h2[rows][1:] != h2[rows][:-1])]
        first[rows[~new]] = False
        total[rows[new]] = np.add.reduceat(copies[rows], np.flatnonzero(new))
    return first, total


def _segment(size: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(start, length)`` of segment ``i`` of lines of each size; :func:`segments` for arrays."""
    k = edits + 1
    short, plain = size // k, k - size % k
    return i * short + np.maximum(0, i - plain), short + (i >= plain)


_KEY_KINDS = (np.uint32, U64, U64)


def _keys(batches: Iterator[pa.RecordBatch], edits: int, share: int, least: int, kinds: tuple[int, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts to arrays ``key, h1, word`` of the index and probe keys of their lines.

    The word holds, from its lowest bit on, 1 for an index key, the size and the byte counts. Only keys of indexed lines whose length class is in ``kinds`` (first one and end) are given.
    """
    # A short line probes the classes of lines that have up to ``edits`` bytes less, a long one those of its own or longer lines.
    longest = 2.0 ** (kinds[1] / 2) + edits if kinds[1] < 2 * 62 else np.inf
    shortest = 2.0 ** (kinds[0] / 2) * (1 - 1 / share) - edits - 1
    for batch in batches:
        for _, offsets, data in text_slices(batch.column(0)):
            start, end, _, _ = line_bounds(offsets, data)
            long = (end - start >= max(least, shortest)) & (end - start < longest)
            start, end = start[long], end[long]
            if not len(start):
                continue
            if 3 * int((end - start).sum()) < 2 * len(data):
                # Other lines cost nothing from here on.
                edge = np.zeros(len(data) + 1, np.int8)
                edge[start] += 1
                edge[end] -= 1  # a line's end is its break, or the next text's first line, which starts there
                data, size = data[np.cumsum(edge[:-1], dtype=np.int8) > 0], end - start
                end = np.cumsum(size)
                start = end - size
            h1, _ = line_names(data, start, end)
            _, own = np.unique(h1, return_index=True)
            own.sort()
            h1, start, end = h1[own], start[own], end[own]
            total, inverse = _fingerprint_sums(data)
            size = end - start
            word = byte_counts(data, start, end, _KEY_COUNTED) | np.minimum(size, (1 << SIZE_BITS) - 1).astype(U64) << U64(1)
            keys, owners, roles = [], [], []

            def add(at: np.ndarray, other: np.ndarray, i: int, s: np.ndarray, n: np.ndarray, indexed: bool) -> None:
                g = (total[s + n] - total[s]) * inverse[s]
                keys.append(mix(g + (other * 8 + i).astype(U64) * U64(0x9E3779B97F4A7C15)))
                owners.append(at)
                roles.append(indexed)

            for key, line, indexed in _long_keys(data, start, size, total, inverse, edits, share, kinds):
                keys.append(key), owners.append(line), roles.append(indexed)
            every = np.flatnonzero(size < share * (edits + 1))
            mine = lambda n: (_length_class(n) >= kinds[0]) & (_length_class(n) < kinds[1])
            for i in range(edits + 1):
                p, n = _segment(size[every], i, edits)
                at = np.flatnonzero(mine(size[every]))
                add(every[at], size[every[at]], i, start[every[at]] + p[at], n[at], True)
                for diff in range(edits + 1):
                    other = size[every] - diff
                    wanted = mine(other)
                    p, n = _segment(other, i, edits)
                    lo = np.maximum(np.maximum(0, p - i), p + diff - (edits - i))
                    hi = np.minimum(np.minimum(size[every] - n, p + i), p + diff + (edits - i))
                    for d in range(-i, i + 1):
                        at = np.flatnonzero((p + d >= lo) & (p + d <= hi) & wanted)
                        add(every[at], other[at], i, start[every[at]] + p[at] + d, n[at], False)
            for lo in range(0, len(keys), 8):
                key, owner = np.concatenate(keys[lo : lo + 8]), np.concatenate(owners[lo : lo + 8])
                role = np.repeat(np.array(roles[lo : lo + 8], U64), [len(o) for o in owners[lo : lo + 8]])
                yield key, h1[owner], word[owner] | role


def _packed_keys(batches: Iterator[pa.RecordBatch], edits: int, share: int, least: int, buckets: int, kinds: tuple[int, int] = (0, 200)) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, h1, word = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        # Within a bucket, half of a key's bits tell it from nearly all others.
        yield from packed.pack([(key >> U64(32)).astype(np.uint32), h1, word], buckets, key)

    for columns in _keys(batches, edits, share, least, kinds):
        held.append(columns)
        rows += len(columns[0])
        if rows >= 2 * COMBINED:
            yield from flush()
            rows = 0
    if held:
        yield from flush()


def budget(size: int, edits: int = EDITS, share: int = SHARE) -> int:
    """Edits that a line of ``size`` bytes may be away from one that isn't longer."""
    return max(edits, size // share)


def run_bytes(edits: int, share: int) -> int:
    """The least length of a segment of a line whose budget grows with it."""
    return share * (edits + 1) // (edits + 2)


def _length_class(size: np.ndarray) -> np.ndarray:
    return np.floor(2 * np.log2(np.maximum(size, 1))).astype(np.int64)


def _long_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.ndarray, inverse: np.ndarray, edits: int, share: int, only: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """``(keys, line of each, indexed)`` of lines that are, or are near, a line of ``share * (edits + 1)`` bytes."""
    run, least = run_bytes(edits, share), share * (edits + 1)
    at = np.flatnonzero(size >= least - least // share)
    if not len(at):
        return
    grams = len(data) - GRAM + 1
    value = mix((total[GRAM:] - total[:-GRAM]) * inverse[:grams])
    # The place in the low half makes the first of equal grams the smallest.
    low = (value & U64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=U64)
    width, have = run - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    place = (low & U64(0xFFFFFFFF)).astype(np.int64)

    def key(q: np.ndarray, kind: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return mix(value[q] + kind.astype(U64) * U64(0xD1B54A32D192ED03) + bucket.astype(U64) * U64(0x8CB92BA72F3D8DD7) + U64(1))

    def reach(kind: np.ndarray) -> np.ndarray:
        return np.maximum(edits, np.ceil(2.0 ** ((kind + 1) / 2)).astype(np.int64) // share)

    of_class = lambda kind: (kind >= only[0]) & (kind < only[1])
    index = at[(size[at] >= least) & of_class(_length_class(size[at]))]
    count = size[index] // share + 1
    line = np.repeat(index, count)
    i = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    q = place[start[line] + i * (size[line] // np.repeat(count, count))]
    kind = _length_class(size[line])
    yield key(q, kind, (q - start[line]) // (16 * reach(kind) + 16)), line, True
    # Neighbouring windows of a line mostly select one gram.
    window = np.flatnonzero(_probed(start[at], size[at], run, edits, share, len(place)))
    q = place[window]
    q = q[np.r_[True, q[1:] != q[:-1]]]
    of = np.searchsorted(start[at], q, "right") - 1
    line = at[of]
    # The other line isn't shorter, by its budget at most longer.
    own, longer = _length_class(size[at]), _length_class(size[at] + size[at] // (share - 1) + 1)
    for n, kinds in enumerate((own, longer)):
        ok = np.flatnonzero((of_class(kinds) & (longer != own if n else True))[of])
        kind, far = kinds[of[ok]], reach(kinds)[of[ok]]
        wide, off = 16 * far + 16, q[ok] - start[line[ok]]
        first, other = (off - far) // wide, (off + far) // wide
        yield key(q[ok], kind, first), line[ok], False
        two = np.flatnonzero(other != first)
        yield key(q[ok[two]], kind[two], other[two]), line[ok[two]], False


def _probed(start: np.ndarray, size: np.ndarray, run: int, edits: int, share: int, places: int) -> np.ndarray:
    """Mask of the places at which a window of these lines may be the first bytes of an unchanged segment of a line that isn't shorter.

    Of ``budget + 1`` segments one, say number i, is unchanged with i edits at most before
    it and ``budget - i`` after it (the first i such that the segments up to it hold i edits
    at most), which bounds its shift from both ends. Lines so long that the other may have
    many budgets look up all windows.
    """
    every = size >= share * share
    lows, highs = [start[every]], [start[every] + size[every] - run]
    at = np.flatnonzero(~every)
    # The other line has this many bytes at least and at most.
    shortest, longest = np.maximum(size, share * (edits + 1)), size + size // (share - 1) + 1
    most = shortest // share
    while len(at := at[most[at] * share <= longest[at]]):
        k = most[at]
        low, high = np.maximum(shortest[at], k * share), np.minimum(np.minimum(longest[at], k * share + share - 1), size[at] + k)
        some = low <= high
        k, low, high, own = k[some], low[some], high[some], at[some]
        i = np.arange(int((k + 1).sum())) - np.repeat(np.cumsum(k + 1) - k - 1, k + 1)
        k, low, high, own = (np.repeat(x, k + 1) for x in (k, low, high, own))
        n, behind = size[own], k - i
        first = np.maximum(i * (low // (k + 1)) + np.maximum(-i, n - high - behind), 0)
        last = np.minimum(i * (high // (k + 1)) + np.minimum(i, n - low + behind), n - run)
        some = first <= last
        lows.append(start[own[some]] + first[some])
        highs.append(start[own[some]] + last[some])
        most[at] += 1
    edge = np.bincount(np.concatenate(lows), minlength=places + 1) - np.bincount(np.concatenate(highs) + 1, minlength=places + 1)
    return np.cumsum(edge)[:places] > 0


def _may_be_near(size: np.ndarray, counts: np.ndarray, p: np.ndarray, q: np.ndarray, edits: int, share: int, groups: int = GROUPS) -> np.ndarray:
    reach = np.maximum(edits, np.maximum(size[p], size[q]) // share)
    return (counts_apart(counts[p], counts[q], groups) <= reach) | (reach >= 1 << (BITS - 1))


def _like_sizes(group: np.ndarray, size: np.ndarray, edits: int, share: int, all_of: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group whose sizes differ by the budget at most; rows are sorted by group and size.

    With ``all_of``, a group of more than ``THINNED`` pairs gets that mask set in place of pairs.
    """
    last = np.searchsorted(group, group, "right")
    at = np.arange(len(group))
    if all_of is not None:
        # Row r reaches rows of up to this size in its group; groups are few bits apart, so each is sought alone.
        big = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for lo in big[last[big] - big > 8192].tolist():
            hi = int(last[lo])
            own = size[lo:hi]
            if int((np.searchsorted(own, np.maximum(own + edits, own + own // (share - 1) + 1), "right") - np.arange(hi - lo)).sum()) > THINNED:
                all_of[lo:hi] = True
        at = at[~all_of]
    step = 1
    while len(at := at[at + step < last[at]]):
        # Sizes go up, so that a row whose next one is too long is done.
        at = at[size[at + step] - size[at] <= np.maximum(edits, size[at + step] // share)]
        for lo in range(0, len(at), 200_000):
            yield at[lo : lo + 200_000], at[lo : lo + 200_000] + step
        step += 1


def _meet(batches: Iterator[pa.RecordBatch], edits: int, share: int) -> Iterator[pa.RecordBatch]:
    """Packed keys to ``key, blocks, h1``: lines that an index entry or a probe of another line may be within the budget of, at a key.

    Sizes and byte counts rule the other pairs of a key out. A key with more than
    ``THINNED`` pairs keeps all its rows, for blocks of its lines to be compared. Keys
    are then named by the set of their lines.
    """
    for key, h, word in packed.gather(batches, _KEY_KINDS):
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        # Most keys stand alone.
        order = order[np.r_[False, same] | np.r_[same, False]]
        if not len(order):
            continue
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        group = np.cumsum(new) - 1
        rows = np.bincount(group)
        ins = np.bincount(group, weights=word[order] & U64(1))
        # A line meets its own index entries in any case; at least one row must be another's.
        other = np.bincount(group, weights=h[order] != h[order][np.flatnonzero(new)][group])
        order = order[((ins > 0) & (ins < rows) & (other > 0))[group]]
        key, h, word = key[order], h[order], word[order]
        size, counts, indexed = (word >> U64(1) & U64((1 << SIZE_BITS) - 1)).astype(np.int64), word >> U64(SIZE_BITS + 1), (word & U64(1)).astype(bool)
        if not len(key):
            continue
        order = np.lexsort((size, key))
        key, h, counts, size, indexed = key[order], h[order], counts[order], size[order], indexed[order]
        ok = np.zeros(len(key), bool)
        for p, q in _like_sizes(key, size, edits, share, ok):
            here = (indexed[p] != indexed[q]) & (h[p] != h[q]) & ~(ok[p] & ok[q])
            p, q = p[here], q[here]
            near = _may_be_near(size, counts, p, q, edits, share, KEY_GROUPS)
            ok[p[near]] = ok[q[near]] = True
        key, h = key[ok], h[ok]
        if not len(key):
            continue
        order = np.lexsort((h, key))
        key, h = key[order], h[order]
        one = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])]
        key, h = key[one], h[one]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lines = np.diff(np.r_[first, len(key)])
        # Like lines share many keys; those with the same lines are one meeting.
        of = mix(np.add.reduceat(mix(h), first) + lines.astype(U64) * U64(0x9E3779B97F4A7C15))
        _, some = np.unique(of, return_index=True)
        own = np.zeros(len(first), bool)
        own[some] = True
        own, key, blocks = np.repeat(own, lines), np.repeat(of, lines), np.repeat(-(-lines // BLOCK), lines)
        key, blocks, h = key[own], blocks[own], h[own]
        for a in range(0, len(key), 100_000):
            s = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(blocks[s].astype(np.int32)), pa.array(h[s].view(np.int64))], names=["key", "blocks", "h1"])


def _middle(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """Both lines without their common ends, which no shortest edit touches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    differs = x[:n] != y[:n]
    head = int(differs.argmax()) if differs.any() else n
    n -= head
    differs = x[len(x) - n :][::-1] != y[len(y) - n :][::-1]
    tail = int(differs.argmax()) if differs.any() else n
    return a[head : len(a) - tail], b[head : len(b) - tail]


#: The largest budget whose band of ``2 * edits + 1`` diagonals fits one word.
WORD_EDITS = 31


def within(a: list[bytes], b: list[bytes], edits: np.ndarray) -> np.ndarray:
    """Whether each pair of lines is within its number of edits, up to ``WORD_EDITS``: bit-parallel columns of a diagonal band, many pairs at once.

    After Myers (1999) and Hyyro (2003): bit k of column j stands for row ``j - edits + k``,
    and the set bits of two words tell where the distance grows or falls by one from row to
    row. It is followed down the lowest diagonal of the band to the last row, then along
    that row. Lines hold no line break, which fills the space around them.
    """
    out = np.zeros(len(a), bool)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    edits = np.asarray(edits, np.int64)
    out[np.maximum(la, lb) <= edits] = True
    todo = np.flatnonzero((np.abs(la - lb) <= edits) & ~out)
    todo = todo[np.argsort(lb[todo], kind="stable")]
    one, lo = U64(1), 0
    while lo < len(todo):
        # Up to 4096 pairs, and 4 MiB of padded bytes.
        hi = min(lo + 4096, len(todo))
        while hi > lo + 1 and (hi - lo) * int(lb[todo[hi - 1]] + 2 * WORD_EDITS) > 1 << 22:
            hi = lo + (hi - lo + 1) // 2
        at = todo[lo:hi]
        lo = hi
        e = edits[at]
        # Equal bytes in front change no distance; the band must end above the last row.
        front = np.where(la[at] <= e, e, 0)
        m, n = la[at] + front, lb[at] + front
        longest = int(max(m.max(), n.max())) + 2 * WORD_EDITS + 3
        x, y = np.full((len(at), longest), 10, np.uint8), np.full((len(at), longest), 10, np.uint8)
        for r, (i, k, f) in enumerate(zip(at.tolist(), e.tolist(), front.tolist(), strict=True)):
            x[r, k : k + f] = y[r, :f] = 32
            x[r, k + f : k + f + la[i]] = np.frombuffer(a[i], np.uint8)
            y[r, f : f + lb[i]] = np.frombuffer(b[i], np.uint8)
        mask = (one << (2 * e + 1).astype(U64)) - one
        top = one << (2 * e).astype(U64)
        up, down = mask >> e.astype(U64) << e.astype(U64), np.zeros(len(at), U64)
        score = e.copy()
        # In column 0 the rows go up by one each.
        j = 0
        while len(at):
            j += 1
            equal = np.packbits(x[:, j - 1 : j + 63] == y[:, j - 1 : j], axis=1, bitorder="little")
            equal = equal.view(U64).ravel() if equal.shape[1] == 8 else np.pad(equal, ((0, 0), (0, 8 - equal.shape[1]))).view(U64).ravel()
            equal &= mask
            same = ((equal & up) + up ^ up | equal | down) & mask
            right_up, right_down = down | mask & ~(same | up), same & up
            along = j > m - e
            row = one << np.clip(m - j + e, 0, 63).astype(U64)
            score += np.where(along, ((right_up & row) != 0).astype(np.int64) - ((right_down & row) != 0), (same & top) == 0)
            same >>= one
            up, down = right_down | mask & ~(same | right_up), same & right_up
            done = n == j
            if done.any() or j % 16 == 0:
                out[at[done]] = score[done] <= e[done]
                # The rest of the text can bring the score down by one a byte, from the row's start on.
                stay = ~done & (score <= e + np.minimum(n - j, n - m + e))
                if not stay.all():
                    at, e, m, n, x, y, mask, top, up, down, score = (v[stay] for v in (at, e, m, n, x, y, mask, top, up, down, score))
    return out


def may_align(a: bytes, b: bytes, edits: int) -> bool:
    """False only if the lines aren't within ``edits``: an edit breaks one of the eight-byte pieces of ``a`` at most, the others stand in ``b`` at nearly their places."""
    missing, find = 0, b.find
    for p in range(0, len(a) - 7, 8):
        if find(a[p : p + 8], max(0, p - edits), p + 8 + edits) < 0:
            missing += 1
            if missing > edits:
                return False
    return True


def within_far(a: bytes, b: bytes, edits: int) -> bool:
    """Whether two lines are within a large budget: bit-parallel columns of a diagonal band (Myers 1999, Hyyro 2003), one pair at a time.

    Bit k of column j stands for row ``j - edits + k``. The distance is followed down the
    lowest diagonal of the band to the last row, then along that row.
    """
    counts = np.bincount(np.frombuffer(a, np.uint8), minlength=256) - np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    if max(int(counts[counts > 0].sum()), -int(counts[counts < 0].sum())) > edits:
        return False
    a, b = _middle(a, b)
    if max(len(a), len(b)) <= edits:
        return True
    if abs(len(a) - len(b)) > edits:
        return False
    if len(a) <= edits:  # the band must end above the last row; equal bytes in front change no distance
        a, b = b" " * edits + a, b" " * edits + b
    m, n = len(a), len(b)
    rows: dict[int, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    mask, top = (1 << 2 * edits + 1) - 1, 1 << 2 * edits
    up, down, score = mask >> edits << edits, 0, edits  # column 0 goes up by one a row
    for j in range(1, n + 1):
        shift = j - edits - 1
        equal = rows.get(b[j - 1], 0)
        equal = (equal >> shift if shift >= 0 else equal << -shift) & mask
        same = ((equal & up) + up ^ up | equal | down) & mask
        right_up, right_down = down | mask & ~(same | up), same & up
        if j <= m - edits:
            if not same & top:
                score += 1
        else:
            row = 1 << m - j + edits
            if right_up & row:
                score += 1
            elif right_down & row:
                score -= 1
        # The rest of the text can bring the score down by one a byte, from the row's start on.
        if score > edits + min(n - j, n - m + edits):
            return False
        same >>= 1
        up, down = right_down | mask & ~(same | right_up), same & right_up
    return score <= edits


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Tables that end where a run of equal leading ``columns`` ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for c in range(columns):
            x = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
            if held:
                change[0] |= x[0] != held[-1].column(c)[held[-1].num_rows - 1].as_py()
        cuts = np.flatnonzero(change)
        if len(cuts) and (held or cuts[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            held = []
        held.append(batch.slice(int(cuts[-1]) if len(cuts) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _first_shared(keys: pa.ListArray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest key that each pair of rows shares; the keys of a row are distinct and go up, and a pair shares one."""
    flat, off = keys.values.to_numpy(), keys.offsets.to_numpy().astype(np.int64)
    out = np.zeros(len(p), np.int64)
    for lo in range(0, len(p), 200_000):
        a, b, at = off[p[lo : lo + 200_000]], off[q[lo : lo + 200_000]], np.arange(lo, min(lo + 200_000, len(p)))
        # The rows of all pairs are merged at once, one step at a time; like lines share one of their first keys.
        while len(at):
            x, y = flat[a], flat[b]
            same = x == y
            out[at[same]] = x[same]
            rest = np.flatnonzero(~same)
            less = (x < y)[rest]
            at, a, b = at[rest], a[rest] + less, b[rest] + ~less
    return out


def _verify(batches: Iterator[pa.RecordBatch], edits: int, share: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``key, i, j, side, h1, copies, keys, line`` sorted by meeting, to ``kind, a, b``.

    A pair counts at the smallest key it shares only. The meetings of a batch are compared together.
    """
    left: list[bytes] = []
    right: list[bytes] = []
    ends: list[tuple[np.ndarray, ...]] = []

    def compared() -> Iterator[pa.RecordBatch]:
        if not ends:
            return
        a, b, copies_a, copies_b, far, _ = (np.concatenate(c) for c in zip(*ends, strict=True))
        ok = np.zeros(len(a), bool)
        few, more = np.flatnonzero(far <= WORD_EDITS), np.flatnonzero(far > WORD_EDITS)
        ok[few] = within([left[i] for i in few.tolist()], [right[i] for i in few.tolist()], far[few])
        for i in more.tolist():
            ok[i] = may_align(left[i], right[i], int(far[i])) and within_far(left[i], right[i], int(far[i]))
        left.clear(), right.clear(), ends.clear()
        if ok.any():
            yield _found(a[ok], b[ok], copies_a[ok], copies_b[ok])

    for t in _whole_groups(batches, 3):
        t = t.combine_chunks()
        key, i, j, h = (t.column(c).to_numpy() for c in ("key", "i", "j", "h1"))
        twice = np.r_[False, (key[1:] == key[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1]) & (h[1:] == h[:-1])]
        if twice.any():
            t = t.filter(pa.array(~twice)).combine_chunks()
        key, i, j, side, h, copies = (t.column(c).to_numpy() for c in ("key", "i", "j", "side", "h1", "copies"))
        raw = t.column("line").chunk(0)
        off = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        size, counts = np.diff(off), byte_counts(data, off[:-1], off[1:])
        group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        order = np.lexsort((size, group))
        sized, grouped = size[order], group[order]
        keys = t.column("keys").chunk(0)
        one, two = [], []
        for p, q in _like_sizes(grouped, sized, edits, share):
            p, q = order[p], order[q]
            here = ((i[p] == j[p]) | (side[p] != side[q])) & (h[p] != h[q])
            p, q = p[here], q[here]
            near = _may_be_near(size, counts, p, q, edits, share)
            one.append(p[near]), two.append(q[near])
        if not one:
            continue
        one, two = np.concatenate(one), np.concatenate(two)
        mine = _first_shared(keys, one, two) == key[one]
        one, two = one[mine], two[mine]
        raw, off = data.tobytes(), off.tolist()
        for lo in range(0, len(one), 20_000):
            p, q = one[lo : lo + 20_000], two[lo : lo + 20_000]
            for rows, into in ((p, left), (q, right)):
                into += [raw[off[r] : off[r + 1]] for r in rows.tolist()]
            ends.append((h[p], h[q], copies[p], copies[q], np.maximum(edits, np.maximum(size[p], size[q]) // share), size[p]))
            # Pairs wait for others, since many are compared in one go.
            if len(left) >= 20_000 or sum(int(x[5].sum()) for x in ends) >= 32 << 20:
                yield from compared()
    yield from compared()


def _found(a: np.ndarray, b: np.ndarray, copies_a: np.ndarray, copies_b: np.ndarray) -> pa.RecordBatch:
    """``kind, a, b`` of linked pairs: how many lines each is linked to, and a spanning forest of the links."""
    name, at = np.unique(np.r_[a, b], return_inverse=True)
    linked = np.bincount(at, weights=np.r_[copies_b, copies_a]).astype(np.int64)
    sets = Unions(len(name))
    tree = [(x, y) for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True) if sets.join(x, y)]
    x, y = (name[[t[k] for t in tree]] for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.r_[np.zeros(len(name), np.int8), np.ones(len(tree), np.int8)]), pa.array(np.r_[name, x]), pa.array(np.r_[linked, y])], names=["kind", "a", "b"])


def classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST_BYTES, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """``(places, classes)``: :func:`line_places`, and ``h1, h2, first, copies, n_links, cls, size, blank, cls_first``.

    One row a distinct line: where it stands first (doc, body, line), its copies, the lines (copies counted)
    of other texts within the distance, its class (all lines reachable by links) and where
    a line of that class stands first. Empty lines are a class like any other. Links name
    lines by the first half of their 128 bits.
    """
    docs = docs.where("doc_id is not null")
    bytes_in = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = packed.bucket_count(bytes_in)
    places = materialize(line_places(docs, buckets), "places")
    uniq = places.where("first").select("h1", "h2", F.struct("doc", "body", "line").alias("first"), "copies", "size", "blank")
    long = uniq.where(F.col("size") >= least)
    parts = []
    for kinds in _shares(long):
        keys = docs.select("text").mapInArrow(lambda b, kinds=kinds: _packed_keys(b, edits, share, least, 4 * buckets, kinds), packed.SCHEMA)
        met = keys.repartition("bucket").mapInArrow(lambda b: _meet(b, edits, share), "key long, blocks int, h1 long")
        parts.append(materialize(met, "keys"))
    meet = reduce(DataFrame.unionByName, parts)
    # The blocks of a key are known before the lines join, which then are dealt out only once.
    of_line = meet.groupBy("h1").agg(F.sort_array(F.collect_set(F.struct("key", "blocks"))).alias("keys"))
    named = long.join(of_line, "h1").select("first.*", "h1", "copies", "keys")
    asked = named.groupBy("doc", "body").agg(F.collect_list(F.struct("line", "h1", "copies", "keys")).alias("asked"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"), F.coalesce("text", F.lit("")).alias("text"))
    have = texts.join(asked, ["doc", "body"]).select("text", "asked")
    lines = materialize(have.mapInArrow(_asked_lines, "line binary, h1 long, copies long, keys array<struct<key:long,blocks:int>>"), "lines")
    rows = lines.select("line", "h1", "copies", F.col("keys.key").alias("keys"), F.explode("keys").alias("k")).select("line", "h1", "copies", "keys", "k.key", "k.blocks")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int"))
    ways = F.expr("transform(sequence(0, blocks - 1), o -> named_struct('i', least(o, own), 'j', greatest(o, own), 'side', if(own <= o, 0, 1)))")
    rows = rows.select("key", F.explode(ways).alias("m"), "h1", "copies", "keys", "line").select("key", "m.i", "m.j", "m.side", "h1", "copies", "keys", "line")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "h1")
    links = materialize(rows.mapInArrow(lambda b: _verify(b, edits, share), "kind byte, a long, b long"), "links")
    for part in (*parts, lines):
        discard(part)
    found = links.where("kind = 0").groupBy(F.col("a").alias("h1")).agg(F.sum("b").alias("n_links"))
    comp = connected_components(links.where("kind = 1"), "a", "b").withColumnRenamed("node", "h1")
    linked = materialize(long.join(found, "h1").join(comp, "h1").withColumnRenamed("component", "cls"), "linked")
    near = linked.groupBy("cls").agg(F.min("first").alias("at"))
    linked = linked.join(near, "cls")
    known = uniq.join(linked.select("h1", "h2", "n_links", "cls", "at"), ["h1", "h2"], "left")
    return places, known.select("h1", "h2", "first", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("cls", "h1").alias("cls"), "size", "blank", F.coalesce("at", "first").alias("cls_first"))


def _shares(lines: DataFrame) -> list[tuple[int, int]]:
    """Length classes (first one and end) that hold about ``PART_SHARE`` of the bytes of all lines each, and all classes together."""
    kind = F.floor(2 * F.log2(F.greatest("size", F.lit(1)))).cast("int")
    rows = sorted(tuple(r) for r in lines.groupBy(kind.alias("kind")).agg(F.sum("size")).collect())  # a class a doubling, twice
    total, cuts, held = sum(n for _, n in rows), [0], 0
    for kind, n in rows:
        if held and held + n > PART_SHARE * total * 1.05:
            cuts.append(kind)
            held = 0
        held += n
    return list(zip(cuts, [*cuts[1:], 200], strict=True))


def _asked_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``text, asked`` to ``line, h1, copies, keys``: the lines asked for, by number.

    Repeated rows answer twice, which :func:`_verify` leaves out.
    """
    for batch in batches:
        for row0, offsets, data in text_slices(batch.column(0)):
            start, end, row, _ = line_bounds(offsets, data)
            asked = batch.column(1).slice(row0, len(offsets) - 1)
            counts = asked.value_lengths().to_numpy(zero_copy_only=False)
            want = asked.flatten()
            first, of = np.searchsorted(row, np.arange(len(offsets))), np.repeat(np.arange(len(offsets) - 1), counts)
            pick = want.field("line").to_numpy() + first[of]
            raw = data.tobytes()
            for a in range(0, len(pick), 5_000):
                part = want.slice(a, 5_000)
                text = [raw[s:e] for s, e in zip(start[pick[a : a + 5_000]].tolist(), end[pick[a : a + 5_000]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), *part.flatten()[1:]], names=["line", "h1", "copies", "keys"])


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_BYTES, share: int = SHARE) -> DataFrame:
    """``doc, body, line, size, blank, repeat, near, links`` of the lines that stand more than once or have a link.

    ``repeat`` tells a line that another one of its class precedes (by doc_id, hash of the
    text, then line), ``near`` one that also differs from all lines before it. Lines of all
    sizes are there; which of them to remove is the caller's choice by ``size`` and ``blank``.
    """
    places, known = classes(docs, edits, least, share)
    # A distinct line that stands once and has no link can't repeat.
    some = materialize(known.where("copies > 1 or n_links > 0"), "some")
    links = (F.col("n_links") + F.col("copies") - 1).alias("links")
    moved = F.col("first") != F.col("cls_first")
    first = some.select("first.*", "size", "blank", moved.alias("repeat"), moved.alias("near"), links)
    later = places.where("not first").select("doc", "body", "line", "h1", "h2", "size", "blank").join(some.select("h1", "h2", "cls_first", links), ["h1", "h2"])
    # Equal rows hold the first place each.
    repeat = F.struct("doc", "body", "line") != F.col("cls_first")
    return first.unionByName(later.select("doc", "body", "line", "size", "blank", repeat.alias("repeat"), F.lit(False).alias("near"), "links"))


def deduplicate(docs: DataFrame, edits: int = EDITS, least: int = LEAST_BYTES, share: int = SHARE, short: bool = False) -> DataFrame:
    """``docs`` with ``n_lines, n_repeats, n_near, n_links, kept_text``; one row a row.

    Of each class of lines, the first line in the order of doc_id and line stays and the
    others go. Lines shorter than ``least`` bytes are a class only with their exact copies:
    with ``short`` those go and count too, except blank ones, without it they stay.
    ``n_links`` sums the other lines equal to or near each line that may go. A null text
    has one empty line. Rows with a null id are left as they are. Texts that share an id
    follow one another by a hash; equal rows are one document, which stays in each. Columns of ``docs`` that have one of the new names
    give way. A text is held whole by one task, with about thirty bytes a byte of it.
    """
    new = ["n_lines", "n_repeats", "n_near", "n_links", "kept_text"]
    docs = docs.drop(*new)
    wanted = (F.col("size") >= least) | (F.lit(short) & ~F.col("blank"))
    rep = repeated_lines(docs, edits, least, share).where(wanted)
    per = rep.groupBy(F.col("doc").alias("_doc"), F.col("body").alias("_body")).agg(
        F.sum("links").alias("n_links"), F.count_if("repeat").alias("n_repeats"), F.count_if("near").alias("n_near"),
        F.collect_set(F.when(F.col("repeat"), F.col("line"))).alias("gone"))
    out = docs.join(per, (docs["doc_id"].cast("long") == per["_doc"]) & (F.xxhash64(docs["text"]) == per["_body"]), "left")
    lines = F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1)
    zero = lambda c: F.coalesce(per[c], F.lit(0)).cast("long").alias(c)
    out = out.select(*(docs[c] for c in docs.columns), F.size(lines).cast("long").alias("n_lines"), zero("n_repeats"), zero("n_near"), zero("n_links"), per["gone"])

    at, of = docs.columns.index("text"), len(out.columns) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(of)
            some = np.flatnonzero(gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            kept = batch.column(at)
            if len(some):
                values = kept.to_pylist() if len(some) * 4 > len(kept) else None
                put = {}
                for i in some.tolist():
                    drop = gone[i].values.to_numpy()
                    parts = (values[i] if values else kept[i].as_py()).split("\n")
                    stay = np.ones(len(parts), bool)
                    stay[drop[drop < len(parts)]] = False
                    put[i] = "\n".join([parts[k] for k in np.flatnonzero(stay).tolist()])
                mask = np.zeros(len(kept), bool)
                mask[some] = True
                kept = pc.replace_with_mask(kept, pa.array(mask), pa.array([put[i] for i in some.tolist()], kept.type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:of], kept], names=[*batch.schema.names[:of], "kept_text"])

    schema = StructType([*out.schema.fields[:of], StructField("kept_text", docs.schema["text"].dataType)])
    return out.mapInArrow(cut, schema)
