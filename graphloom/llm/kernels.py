"""Vectorised text kernels over Arrow string columns, shared by the text operators.

Every kernel works on slices of a bounded number of bytes, so that the memory of a
task doesn't follow the batch size; only one text longer than the bound stands alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15
_STEP_INV = pow(_STEP, -1, 1 << 64)
_pows: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_STEP))
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i below ``n``; kept and grown up to 4 M entries."""
    have = _pows.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 12), base, U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 1 << 22:
            _pows[base] = have
    return have[:n]


def text_slices(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, byte offsets from 0, bytes)`` of runs of rows of at most ``max_bytes`` (or one row). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        j = min(j, n)
        yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one integer; bytes behind the end are zero."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Runs of more bytes are named one by one.
_LONG_RUN = 64


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit names of the byte runs ``start:end``, which hold no zero bytes.

    Up to eight bytes, different runs have different names. Longer ones take a non-linear
    round for every eight bytes, and those beyond 64 bytes an XXH3, so that no arithmetic
    between bytes (as in a polynomial modulo 2**64) makes unlike runs agree.
    """
    size = end - start
    eight = loads(data)
    out = mix(eight[start] & _FIRST_BYTES[np.minimum(size, 8)])
    at = np.flatnonzero((size > 8) & (size <= _LONG_RUN))
    h, done = out[at] + U64(0x2545F4914F6CDD1D), 8
    while len(at):
        left = size[at] - done
        h = mix(h * U64(0xA0761D6478BD642F) ^ (eight[start[at] + done] & _FIRST_BYTES[np.minimum(left, 8)]))
        done += 8
        ended = left <= 8
        out[at[ended]] = h[ended]
        at, h = at[~ended], h[~ended]
    for i in np.flatnonzero(size > _LONG_RUN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def text_of(raw: bytes) -> str:
    """The text of UTF-8 bytes; each maximal part that isn't UTF-8 becomes U+FFFD."""
    return raw.decode("utf-8", "replace")


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash of each word, byte position of each word, first word of each row and the end)``.

    A word is a maximal run of ASCII letters, digits and non-ASCII bytes; equal words get equal hashes.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = WORD_BYTE[data]
    edge = np.empty(n, bool)
    edge[0] = True
    np.logical_not(inside[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(inside & edge)
    stop = np.empty(n, bool)
    stop[-1] = True
    np.logical_not(inside[1:], out=stop[:-1])
    last = offsets[1:] - 1
    stop[last[last >= 0]] = True
    end = np.flatnonzero(inside & stop)
    return names(data, start, end + 1), start, np.searchsorted(start, offsets)


def grams(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of each run of size words, first run of each row and the end)``; runs don't cross rows."""
    n = len(h) - size + 1
    counts = np.maximum(np.diff(first) - size + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    if n <= 0 or not starts[-1]:
        return np.zeros(0, U64), np.zeros_like(starts)
    g = h[:n].copy()
    for k in range(1, size):
        g *= U64(0xD6E8FEB86659FD93)
        g += h[k : k + n]
    where = np.arange(starts[-1]) + np.repeat(first[:-1] - starts[:-1], counts)
    return mix(g[where]), starts


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring ``starts``; empty rows give 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


class Unions:
    """Disjoint sets over small integers, for links found inside one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def valid_text(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as UTF-8; those that aren't get U+FFFD for each part that isn't."""
    raw = data.tobytes()
    try:
        raw.decode()
        if not (data[offsets[:-1][offsets[:-1] < len(data)]] & 0xC0 == 0x80).any():
            return offsets, data
    except UnicodeDecodeError:
        pass
    rows = [text_of(raw[a:b]).encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.cumsum([0, *map(len, rows)]), np.frombuffer(b"".join(rows), np.uint8)


def fold(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes. ASCII and U+00C0..U+00FF go by a table; slices with other letters by Arrow's Unicode rule."""
    if len(data) and data.max() >= 0xC4:
        offsets, data = valid_text(offsets, data)
        column = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        column = pc.utf8_lower(column)
        off = np.frombuffer(column.buffers()[1], np.int64)[: len(offsets)]
        return off, np.frombuffer(column.buffers()[2] or b"", np.uint8)[: off[-1]]
    out = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        tail = data[lead + 1]
        at = lead[(tail <= 0x9E) & (tail != 0x97)] + 1
        out[at] += 32
    return offsets, out
