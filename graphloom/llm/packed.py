"""Numeric rows that are shuffled in packed blocks: one shuffled row holds many rows of one bucket.

Where a stage gives many small numeric rows, Spark's cost by row outweighs the data. A task
packs the rows of each bucket into one block of bytes; the task that gets a bucket unpacks
its blocks and sorts them as arrays.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from .kernels import U64

SCHEMA = "bucket int, rows int, block binary"
#: Rows that one task holds as arrays; beyond them, a bucket is split on the executor's disk.
HELD = 6_000_000
#: Parts of a bucket that is split.
SPLIT = 64


#: Bytes of input for each bucket, and buckets at most and at least.
BUCKET_BYTES, MOST_BUCKETS, LEAST_BUCKETS = 1 << 20, 16_384, 16


def bucket_count(size: int) -> int:
    """Buckets for an input of ``size`` bytes. Beyond 16 GiB they hold more each, and tasks split them on disk."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))


def pack(columns: Sequence[np.ndarray], buckets: int, key: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows given as ``columns``; ``key``, or else the first column, 64 bits wide, names the bucket. The first column has 32 bits or more."""
    bucket = ((columns[0] if key is None else key).view(U64) % U64(buckets)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(bucket))
    for lo in range(0, len(first), 256):
        s, e = first[lo : lo + 256].tolist(), ends[lo : lo + 256].tolist()
        blocks = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(s, e, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first[lo : lo + 256]].astype(np.int32)), pa.array([j - i for i, j in zip(s, e, strict=True)], pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "rows", "block"])


def _unpack(blocks: list[tuple[int, bytes]], kinds: Sequence[type]) -> list[np.ndarray]:
    out = []
    at = [0] * len(blocks)
    for kind in kinds:
        width = np.dtype(kind).itemsize
        parts = []
        for i, (rows, raw) in enumerate(blocks):
            parts.append(np.frombuffer(raw, kind, rows, at[i]))
            at[i] += rows * width
        out.append(np.concatenate(parts))
    return out


def gather(batches: Iterator[pa.RecordBatch], kinds: Sequence[type], held: int = HELD) -> Iterator[list[np.ndarray]]:
    """Arrays of the rows of a task; all rows of one bucket with an equal first column are in the same arrays."""
    blocks: list[tuple[int, bytes]] = []
    rows, files = 0, None

    def spill() -> None:
        columns = _unpack(blocks, kinds)
        first = columns[0].view(f"u{columns[0].itemsize}")
        part = (first >> first.dtype.type(8 * first.itemsize - 24)) % first.dtype.type(SPLIT)
        for k, f in enumerate(files):
            mine = part == k
            n = int(mine.sum())
            if n:
                f.write(n.to_bytes(8, "little") + b"".join(c[mine].tobytes() for c in columns))

    try:
        for batch in batches:
            for n, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                blocks.append((n, raw))
                rows += n
                if rows >= held:
                    files = files or [tempfile.TemporaryFile() for _ in range(SPLIT)]
                    spill()
                    blocks, rows = [], 0
        if files is None:
            if blocks:
                yield _unpack(blocks, kinds)
            return
        if blocks:
            spill()
            blocks = []
        width = sum(np.dtype(k).itemsize for k in kinds)
        for f in files:
            f.seek(0)
            part = []
            while head := f.read(8):
                n = int.from_bytes(head, "little")
                part.append((n, f.read(n * width)))
            if part:
                yield _unpack(part, kinds)
    finally:
        for f in files or []:
            f.close()
