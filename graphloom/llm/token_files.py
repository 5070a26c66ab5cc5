"""Token files: the ids of a corpus in order of its documents, Huffman-coded in independent blocks.

A directory has three Parquet tables, so that any store Spark reaches can hold it:

- ``code``: ``id, length`` of the ids that occur. The codes are canonical, so lengths say all.
- ``blocks``: ``part, block, first`` (ids of the part before the block), ``n_ids``, the
  documents in it (``doc_ids, counts``), ``checkpoints`` (unsigned 32-bit differences of the
  bit offsets of every 256th id) and ``bits``.
- ``parts``: ``part, first`` (ids of the corpus before the part) and ``n_ids``.

A block holds whole documents, up to about a quarter of a million ids; a longer document is
a block of its own. Parts follow one another in ascending order of document.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import huffman
from .storage import discard, materialize, shared_dir
from .word_tokens import ByteLevel, public_path, vocabulary

BLOCK_IDS = 1 << 18
END_ID = 0


def _blocks(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int) -> DataFrame:
    """``part, block, first, doc_ids, counts, ids`` of documents that lie in order already."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ByteLevel, public_path(tokenizer), True)
        part, block, first = TaskContext.get().partitionId(), 0, 0
        names, counts, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, names, counts, held, size
            own = pa.concat_arrays(names)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                 pa.array([np.concatenate(counts)], pa.list_(pa.int64())), pa.array([np.concatenate(held).astype("<u4").tobytes()], pa.binary())],
                names=["part", "block", "first", "doc_ids", "counts", "ids"],
            )
            block, first = block + 1, first + size
            names, counts, held, size = [], [], [], 0
            return out

        for batch in batches:
            for row, ids, bounds in words.rows(batch.column(1)):
                n, k = np.diff(bounds) + 1, len(bounds) - 1
                full = np.full(len(ids) + k, end_id, np.uint32)
                stop = np.cumsum(n)
                inner = np.ones(len(full), bool)
                inner[stop - 1] = False
                full[inner] = ids
                i = 0
                while i < k:
                    before = int(stop[i] - n[i])
                    j = max(int(np.searchsorted(stop, before + block_ids - size, "right")), i if size else i + 1)
                    if j > i:
                        names.append(batch.column(0).slice(row + i, j - i)), counts.append(n[i:j]), held.append(full[before : stop[j - 1]])
                        size += int(stop[j - 1]) - before
                    if j < k:
                        yield flush()
                    i = j
        if names:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"part int, block int, first long, doc_ids array<{kind}>, counts array<long>, ids binary")


def _id_counts(blocks: DataFrame) -> DataFrame:
    """``id, n`` over all blocks; each task sends its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                own = np.bincount(np.frombuffer(raw.as_buffer(), "<u4"))
                if len(own) > len(total):
                    total, own = own, total
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at].astype(np.int64))], names=["id", "n"])

    return blocks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _encoded(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    code = huffman.codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, points, bits = [], [], []
            for raw in batch.column(5):
                ids = np.frombuffer(raw.as_buffer(), "<u4")
                own, at = huffman.encode(ids, lengths, code)
                n.append(len(ids)), bits.append(own), points.append(np.diff(at, prepend=0).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), *batch.columns[3:5], pa.array(points, pa.binary()), pa.array(bits, pa.binary())], names=["part", "block", "first", "n_ids", "doc_ids", "counts", "checkpoints", "bits"])

    kind = blocks.schema["doc_ids"].dataType.simpleString()
    return blocks.mapInArrow(run, f"part int, block int, first long, n_ids long, doc_ids {kind}, counts array<long>, checkpoints binary, bits binary")


def write(docs: DataFrame, path: str | None = None, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> str:
    """Write the ids of ``docs`` (``doc_id, text``) in ascending order of ``doc_id``, each document closed by ``end_id``; returns the directory.

    Null ids come first; rows of one id follow by a hash of their texts. A null or empty text
    is its end id alone; strings of special tokens in a text are those tokens, as the library takes them. Bytes that aren't UTF-8 count as U+FFFD. An empty table gives
    empty files. A text is held whole by one task, with some twenty bytes a byte of it. The
    driver gets one row for each id of the vocabulary and one for each part.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/token-files/{uuid.uuid4().hex}"
    d = docs.select("doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    d = d.select("doc_id", "text", order[1].alias("_h"), order[2].alias("_i"))
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_h", "_i").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h", "_i")
    blocks = materialize(_blocks(d, tokenizer, end_id, block_ids), "ids")
    try:
        found = _id_counts(blocks).collect()  # a row for each id of the vocabulary
        counts = np.zeros(max((r.id for r in found), default=-1) + 1, np.int64)
        for r in found:
            counts[r.id] = r.n
        lengths = huffman.code_lengths(counts)
        used = np.flatnonzero(lengths)
        spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/code")
        _encoded(blocks, lengths).write.parquet(f"{path}/blocks")
    finally:
        discard(blocks)
    per = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids")).orderBy("part").collect()  # a row for each part
    first = np.cumsum([0, *(r.n_ids for r in per)]).tolist()
    spark.createDataFrame([(r.part, s, r.n_ids) for r, s in zip(per, first, strict=False)], "part int, first long, n_ids long").coalesce(1).write.parquet(f"{path}/parts")
    return path


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document in a directory of :func:`write`, decoded from its files; with ``ids``, also the ids themselves."""
    code = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r.id for r in code), default=-1) + 1, np.uint8)
    for r in code:
        lengths[r.id] = r.length
    base = {r.part: r.first for r in spark.read.parquet(f"{path}/parts").collect()}
    blocks = spark.read.parquet(f"{path}/blocks")
    columns = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, top = huffman.table(lengths)
        for batch in batches:
            part, first, n, names, counts, points, bits = batch.columns
            for i in range(len(batch)):
                own = huffman.decode(bits[i].as_py(), np.cumsum(np.frombuffer(points[i].as_buffer(), "<u4"), dtype=np.int64), n[i].as_py(), entries, top).astype("<u4")
                size = counts[i].values.to_numpy()
                stop = np.cumsum(size)
                raw = memoryview(own.view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stop - size).tolist(), stop.tolist(), strict=True)]
                out = [names[i].values, pa.array(stop - size + first[i].as_py() + base[part[i].as_py()]), counts[i].values, pa.array(crc, pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, stop), pa.int32()), pa.array(own.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=columns)

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    b = blocks.select("part", "first", "n_ids", "doc_ids", "counts", "checkpoints", "bits")
    return b.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))
