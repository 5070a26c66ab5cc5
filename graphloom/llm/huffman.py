"""Canonical Huffman codes of limited length over integer ids, with vectorised encoding and table-driven decoding."""

from __future__ import annotations

import numpy as np

#: Bits of the longest code, and so of the decoding table's index.
LIMIT = 20
#: Ids between two checkpoints of a block.
STRIDE = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The length in bits of each id's code, 0 for ids that don't occur: the best prefix code with none beyond ``limit``.

    Coins are packed and merged level by level. A level's cheapest coins are the ids
    themselves or pairs of the level before, so it is enough to remember which is which.
    """
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    single = counts[order].astype(np.float64)  # exact below 2**53
    level, kinds = single, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([single, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        kinds.append(by < n)
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for kind in reversed(kinds):
        k = int(kind[:take].sum())
        length[:k] += 1
        take = 2 * (take - k)
    out[order] = length
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes: ascending by length, then by id."""
    out = np.zeros(len(lengths), np.uint64)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    if len(order):
        top = int(lengths.max())
        room = np.uint64(1) << (np.uint64(top) - lengths[order].astype(np.uint64))
        at = np.cumsum(room) - room
        out[order] = at >> (np.uint64(top) - lengths[order].astype(np.uint64))
    return out


def encode(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``(bits of the block, bit offset of every STRIDE-th id)``."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    stop = np.cumsum(size)
    start = stop - size
    value, shift = code[ids], (start & 63) + size
    word = start >> 6
    over = shift > 64
    left = np.where(over, 0, 64 - shift).astype(np.uint64)
    spill = np.where(over, shift - 64, 0).astype(np.uint64)
    out = np.zeros((int(stop[-1]) >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] = np.bitwise_or.reduceat((value << left) >> spill, first)
    k = np.flatnonzero(over)
    out[word[k] + 1] |= value[k] << (np.uint64(64) - spill[k])
    return out.astype(">u8").tobytes()[: -(-int(stop[-1]) // 8)], start[::STRIDE]


def table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """``(entries, bits)``: under each string of so many bits, the id whose code it begins with and that code's length, packed as ``id * 32 + length``."""
    top = int(lengths.max()) if len(lengths) else 0
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    entry = (order.astype(np.int64) << 5) | lengths[order]
    out = np.zeros(1 << top, np.int64)
    filled = np.repeat(entry, 1 << (top - lengths[order].astype(np.int64)))
    out[: len(filled)] = filled
    return out, top


def decode(bits: bytes, checkpoints: np.ndarray, n: int, entries: np.ndarray, top: int) -> np.ndarray:
    """The ``n`` ids of a block: all stretches between checkpoints are read side by side, one id each a step."""
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.zeros(len(bits) + STRIDE * top // 8 + 8, np.uint8)
    raw[: len(bits)] = np.frombuffer(bits, np.uint8)
    window = np.ndarray(len(raw) - 3, ">u4", raw, strides=(1,))
    at = checkpoints.astype(np.int64)
    steps = min(STRIDE, n)
    out = np.empty((steps, len(at)), np.uint32)
    mask = (1 << top) - 1
    for i in range(steps):
        found = entries[(window[at >> 3].astype(np.int64) >> (32 - top - (at & 7))) & mask]
        out[i] = found >> 5
        at += found & 31
    return out.T.reshape(-1)[:n] if steps == STRIDE else out[:, 0][:n]
