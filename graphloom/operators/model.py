"""From documents to the graph model: windows, mentions, edges and canonical entities.

Every function takes and returns DataFrames and works on all tenants at once: ``user_id``
and ``kb_id`` are part of every key.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import ENTITY_TYPES, is_function_word, normalized
from .sentences import found, pattern_matches

KB = ["user_id", "kb_id"]
#: Bytes of a passage window and of its overlap.
PASSAGE = (3000, 300)
#: The smaller windows that the graph is built on.
GRAPH_WINDOW = (600, 60)
MENTION_LIMIT = 25
MENTION = "[A-Z][a-z]{3,}"


#: Ids are written in decimal places up to here; what has no place there has a hash of its parts below zero.
PLACES = {"document": 9_000_000_000, "window": 100_000, "mention": 10_000}


def _placed(parts: list[Column], limits: list[int]) -> Column:
    """A readable id of small parts (the first one times the limits of the rest), else a negative 63-bit hash of them, so that neither overflows nor meets the other."""
    fits, value = parts[0].between(0, limits[0] - 1), parts[0]
    for part, limit in zip(parts[1:], limits[1:], strict=True):
        fits, value = fits & part.between(0, limit - 1), value * limit + part
    return F.when(fits, value).when(F.coalesce(*parts).isNotNull(), -1 - F.xxhash64(*parts).bitwiseAND((1 << 62) - 1))


#: Bytes of windows, or characters of mentions, that a task hands on in one piece.
_PIECE = 1 << 22


def _inside(d: bytes, at: int) -> bool:
    return 0 < at < len(d) and d[at] & 0xC0 == 0x80


def _place(d: bytes, at: int, after: int) -> int:
    """A byte offset moved back to the start of its character, or on to the next one where that would not lead beyond ``after``."""
    back = at
    while _inside(d, back):
        back -= 1
    if back > after:
        return back
    while _inside(d, at):
        at += 1
    return min(len(d), at)


def _bounds(d: bytes, size: int, step: int) -> Iterator[tuple[int, int]]:
    """Start and end of each window of a text."""
    s, n = 0, len(d)
    while True:
        e = n if s + size >= n else _place(d, s + size, s)
        yield s, e
        if e >= n:
            return
        s = _place(d, s + step, s)


def _spread(batch: pa.RecordBatch, keep: list[str], each, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows of ``each(bytes)`` (their first value counts for a piece's size) beside the columns ``keep`` of the row that the bytes are of."""
    data = batch.column(batch.schema.names.index("_bytes"))
    own = batch.select(keep)
    rows, out, held = [], [], 0

    def piece() -> pa.RecordBatch:
        found = [pa.array(x, pa.binary() if k == pa.string() else k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
        found = [x.view(pa.string()) if k == pa.string() else x for x, k in zip(found, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*own.take(pa.array(rows, pa.int64())).columns, *found], names=[*keep, *names])

    for i in range(len(batch)):
        for row in each(data[i].as_py()):
            rows.append(i)
            out.append(row)
            held += len(row[0])
            if held >= _PIECE:
                yield piece()
                rows, out, held = [], [], 0
    if out:
        yield piece()


def windows(docs: DataFrame, size: int = PASSAGE[0], overlap: int = PASSAGE[1]) -> DataFrame:
    """Byte windows of fixed size with overlap, cut at character starts only.

    Adds ``chunk_id, ordinal, text, token_count, char_start, char_end`` (byte offsets, end
    exclusive) in place of the text. Empty and null texts give no window. A place inside a
    character moves back to its start or, where that would not lead on, to the next one.
    """
    step = max(1, size - overlap)
    keep = ["document_id", *KB]

    def cut(d: bytes) -> Iterator[tuple]:
        return ((d[s:e], i, s, e) for i, (s, e) in enumerate(_bounds(d, size, step)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _spread(batch, keep, cut, ["text", "ordinal", "char_start", "char_end"], [pa.string(), pa.int32(), pa.int32(), pa.int32()])

    d = docs.where("text is not null and text <> ''").select(*keep, F.encode("text", "UTF-8").alias("_bytes"))
    d = d.mapInArrow(run, StructType([*d.drop("_bytes").schema.fields, *StructType.fromDDL("text string, ordinal int, char_start int, char_end int").fields]))
    return d.select(
        _placed([F.col("document_id"), F.col("ordinal")], [PLACES["document"], PLACES["window"]]).alias("chunk_id"), *keep, "ordinal", "text",
        F.floor((F.col("char_end") - F.col("char_start")) / 4).cast("int").alias("token_count"), "char_start", "char_end",
    )


def default_type(text: Column) -> Column:
    """A stand-in for a model's label: the type follows from the last letter."""
    return F.element_at(F.array(*map(F.lit, ENTITY_TYPES)), (F.pmod(F.ascii(F.right(text, F.lit(1))) - 97, F.lit(7)) + 1).cast("int"))


def default_score(text: Column) -> Column:
    """A stand-in for a model's confidence, from the length."""
    return F.pmod(F.length(text) * 7, F.lit(10)) / F.lit(10.0)


def _ascii_matches(chunks: DataFrame) -> DataFrame:
    """The matches of the default pattern: ``chunk_id, document_id, user_id, kb_id, m`` (text)``, k`` (number in its window)``, s`` (byte offset)."""
    keep = ["chunk_id", "document_id", *KB]
    match = re.compile(MENTION.encode()).finditer

    def hits(d: bytes) -> Iterator[tuple]:
        return ((x.group(), k, x.start()) for k, x in enumerate(match(d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _spread(batch, keep, hits, ["m", "k", "s"], [pa.string(), pa.int32(), pa.int32()])

    c = chunks.where("text is not null").select(*keep, F.encode("text", "UTF-8").alias("_bytes"))
    return c.mapInArrow(run, StructType([*c.drop("_bytes").schema.fields, *StructType.fromDDL("m string, k int, s int").fields]))


def mentions(chunks: DataFrame, pattern: str = MENTION, threshold: float = 0.5, kind=default_type, score=default_score, find=None) -> DataFrame:
    """``mention_id, chunk_id, document_id, user_id, kb_id, entity_type, text, char_start, char_end, score``.

    Matches of ``pattern`` in each sentence of a window, with byte offsets in the window; ones
    below the threshold, shorter than two characters or function words are left out. ``find``
    (in place of the pattern), ``kind`` and ``score`` are the places for a model. Null and
    empty texts give no rows.

    A match of the default pattern holds neither space nor stop, so none reaches over the end
    of a sentence, and ASCII letters only: windows are searched whole for it, as bytes, whose
    places are the offsets. Other patterns and their offsets stay in the JVM.
    """
    if find is None and pattern == MENTION:
        c = _ascii_matches(chunks)
    else:
        c = chunks.withColumn("f", found(F.col("text"), find or pattern_matches(pattern))).select("chunk_id", "document_id", *KB, F.posexplode("f").alias("k", "z"))
        c = c.select("chunk_id", "document_id", *KB, "k", F.col("z.m").alias("m"), F.col("z.s").alias("s"))
    return _judged(c, threshold, kind, score)


def _judged(c: DataFrame, threshold: float, kind, score) -> DataFrame:
    """Matches (``chunk_id, document_id, user_id, kb_id, k, m, s``) as mentions, without the ones that are left out."""
    t = F.col("m")
    c = c.select(
        _placed([F.col("chunk_id"), F.col("k")], [PLACES["document"] * PLACES["window"], PLACES["mention"]]).alias("mention_id"), "chunk_id", "document_id", *KB, kind(t).alias("entity_type"), t.alias("text"),
        F.col("s").alias("char_start"), (F.col("s") + F.octet_length(t)).alias("char_end"), score(t).alias("score"),
    )
    return c.where((F.col("score") >= threshold) & (F.length(F.trim("text")) >= 2) & ~is_function_word(F.col("text")))


def _default_matches(b: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, ...]:
    """The matches of the default pattern in the windows ``spans`` (starts and ends in ``b``): window, number in it, start in it, and the texts' offsets and bytes.

    A match starts at a capital and ends with its run of small letters or its window; only the
    last one of a window can be cut below four letters.
    """
    capital, small = (b - np.uint8(65)) < 26, (b - np.uint8(97)) < 26
    at = np.flatnonzero(capital[:-3] & small[1:-2] & small[2:-1] & small[3:])
    other = np.append(np.flatnonzero(~small), len(b))
    until = other[np.searchsorted(other, at + 1)]
    low, high = np.searchsorted(at, spans[0]), np.searchsorted(at, spans[1])
    n = high - low
    window = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    i = low[window] + k
    start, end = at[i], np.minimum(until[i], spans[1][window])
    whole = end - start >= 4
    window, k, start, end = window[whole], k[whole], start[whole], end[whole]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    text = b[np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])]
    return window, k, start - spans[0][window], offsets, text


def window_mentions(docs: DataFrame, size: int = GRAPH_WINDOW[0], overlap: int = GRAPH_WINDOW[1], threshold: float = 0.5, kind=default_type, score=default_score) -> DataFrame:
    """``mentions(windows(docs, size, overlap))`` with the default pattern in one pass over the texts, so that no window leaves its task.

    Windows are searched some ``_PIECE`` bytes at a time, however long a text is.
    """
    step = max(1, size - overlap)
    keep = ["document_id", *KB]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index("_bytes"))
            kind_of = np.int64 if pa.types.is_large_binary(column.type) else np.int32
            _, places, data = column.buffers()
            places = np.frombuffer(places, kind_of)[column.offset : column.offset + len(column) + 1].tolist()
            view, b, own = memoryview(data).cast("B"), np.frombuffer(data, np.uint8), batch.select(keep)

            def piece(rows: list[tuple[int, int, int, int]], b=b, own=own) -> pa.RecordBatch:
                doc, ordinal, s, e = np.array(rows, np.int64).T
                window, k, start, offsets, text = _default_matches(b[s[0] : e[-1]], np.stack([s, e]) - s[0])
                m = pa.StringArray.from_buffers(len(window), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text))
                found = [pa.array(ordinal[window].astype(np.int32)), m, pa.array(k.astype(np.int32)), pa.array(start.astype(np.int32))]
                return pa.RecordBatch.from_arrays([*own.take(pa.array(doc[window])).columns, *found], names=[*keep, "ordinal", "m", "k", "s"])

            rows: list[tuple[int, int, int, int]] = []
            for i, (first, last) in enumerate(zip(places, places[1:], strict=False)):
                for ordinal, (s, e) in enumerate(_bounds(view[first:last], size, step)):
                    rows.append((i, ordinal, first + s, first + e))
                    if first + e - rows[0][2] >= _PIECE:
                        yield piece(rows)
                        rows = []
            if rows:
                yield piece(rows)

    d = docs.where("text is not null and text <> ''").select(*keep, F.encode("text", "UTF-8").alias("_bytes"))
    d = d.mapInArrow(run, StructType([*d.drop("_bytes").schema.fields, *StructType.fromDDL("ordinal int, m string, k int, s int").fields]))
    chunk = _placed([F.col("document_id"), F.col("ordinal")], [PLACES["document"], PLACES["window"]]).alias("chunk_id")
    return _judged(d.select(chunk, *keep, "k", "m", "s"), threshold, kind, score)


def resolve(m: DataFrame, compatibility: bool = True) -> DataFrame:
    """Mentions with ``normalized_text`` and ``canonical_id``: the smallest mention id of equal (tenant, kb, text, type)."""
    m = m.withColumn("normalized_text", normalized(F.col("text"), compatibility))
    key = [*KB, "normalized_text", "entity_type"]
    known = F.expr(" and ".join(f"{k} is not null" for k in key))
    return m.where(known).withColumn("canonical_id", F.min("mention_id").over(Window.partitionBy(*key)))


def canonical(resolved: DataFrame) -> DataFrame:
    """One row an identity: its first mention's text, and its counts of mentions and documents."""
    return resolved.groupBy(*KB, "canonical_id").agg(
        F.min_by("text", "mention_id").alias("canonical_text"), F.min_by("normalized_text", "mention_id").alias("normalized_text"), F.min_by("entity_type", "mention_id").alias("entity_type"),
        F.count("*").alias("mention_count"), F.countDistinct("document_id").alias("document_count"),
    )


def identities(resolved: DataFrame) -> DataFrame:
    """:func:`canonical` of the rows of :func:`resolve` as they are: dealt by text and type already, so that no row moves again."""
    g = resolved.groupBy(*KB, "normalized_text", "entity_type", "canonical_id").agg(F.min_by("text", "mention_id").alias("canonical_text"), F.count("*").alias("mention_count"), F.countDistinct("document_id").alias("document_count"))
    return g.select(*KB, "canonical_id", "canonical_text", "normalized_text", "entity_type", "mention_count", "document_count")


def edges(m: DataFrame, limit: int = MENTION_LIMIT) -> DataFrame:
    """Co-occurrence pairs ``a < b`` inside a window; windows with more than ``limit`` mentions give none at all.

    The limit bounds a window's group, so its pairs are made from one collected array.
    """
    per = m.groupBy("chunk_id", "document_id", *KB).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("mention_id")).alias("ids")).where(F.col("n").between(2, limit))
    pairs = F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> named_struct('a', x, 'b', y))))")
    e = per.select("chunk_id", "document_id", *KB, F.explode(pairs).alias("p"))
    return e.select("chunk_id", "document_id", *KB, F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.lit(1).alias("co_occurrence_count"))


def review(e: DataFrame) -> DataFrame:
    """A stand-in for a reviewer's verdict on each pair: a relation, ``none``, or null for one not reviewed."""
    third = F.pmod(F.col("a") + F.col("b"), F.lit(3))
    return e.withColumn("relation_type", F.when(third == 0, "linked").when(third == 1, "none"))


def lift(e: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges with the canonical ids of both ends, ordered, without pairs of one identity."""
    one = resolved.select(F.col("mention_id").alias("a"), F.col("canonical_id").alias("ca"))
    two = resolved.select(F.col("mention_id").alias("b"), F.col("canonical_id").alias("cb"))
    return e.join(one, "a").join(two, "b").where("ca is not null and cb is not null and ca <> cb").withColumn("x", F.least("ca", "cb")).withColumn("y", F.greatest("ca", "cb"))


def cross_links(canon: DataFrame, apart: int = 7) -> DataFrame:
    """A stand-in for confirmed cross-window relations: every identity and the one ``apart`` places on in its knowledge base."""
    w = Window.partitionBy(*KB).orderBy("canonical_id")
    c = canon.select(*KB, F.col("canonical_id").alias("a"), F.lead("canonical_id", apart).over(w).alias("b")).where("b is not null")
    return c.withColumn("relation_type", F.when(F.col("a") % 2 == 0, "linked").otherwise("none"))


class Tables:
    """The derived tables of one directory. Queries share them, so each is persisted at its first use (memory, then disk).

    The windows are not: their texts are larger than the documents, and one pass cuts them again.
    """

    def __init__(self, spark, sf_dir: str, size: int = GRAPH_WINDOW[0], overlap: int = GRAPH_WINDOW[1]):
        from ..sources.tables import documents

        self.docs = documents(spark, sf_dir)
        self.chunks = windows(self.docs, size, overlap)
        self.mentions = window_mentions(self.docs, size, overlap).persist()
        # Matches of the default pattern are ASCII, which NFKC leaves as it is.
        self.resolved = resolve(self.mentions, compatibility=False).persist()
        self.canonical = identities(self.resolved).persist()
        self.edges = review(edges(self.mentions)).persist()
        self.cross = cross_links(self.canonical).persist()


    def fulltext(self):
        """The saved full-text index of the passages, written at its first use."""
        from ..sources.lineage import shared_folder
        from .fulltext import Saved, index, save

        if not hasattr(self, "_index"):
            path = f"{shared_folder(self.docs.sparkSession)}/fulltext-{uuid.uuid4().hex}"
            save(index(windows(self.docs)), path)
            self._index = Saved(self.docs.sparkSession, path)
        return self._index


_kept: dict[tuple[str, str], Tables] = {}


def Model(spark, sf_dir: str) -> Tables:  # noqa: N802
    """The tables of a directory in this session, derived once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        for old in [k for k in _kept if k[0] == key[0]]:
            for t in vars(_kept[old]).values():
                if isinstance(t, DataFrame) and t is not _kept[old].docs:
                    t.unpersist()
        _kept.clear()
        _kept[key] = Tables(spark, sf_dir)
    return _kept[key]
