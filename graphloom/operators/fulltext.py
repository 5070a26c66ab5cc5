"""Full text: an inverted index of stemmed words with their places, web-style queries and ranks.

The index is a table ``user_id, kb_id, term, chunk_ids, ends, places``. A query reads the rows
of its few terms and never a text: a saved index is dealt to folders by a hash of the term,
and sorted by term within.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.stem import stem, stem_sql, stem_word
from .model import KB

# English words that are too common to be searched for.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: A word, for checks; tasks find it by the categories of code points.
WORD = r"[\p{L}\p{N}]+"
SHARDS = 64
#: Weight of a word's place, and the sum of 1/i**2 over all i, which bounds what repeated places add.
WEIGHT, LIMIT = 0.1, 1.64493406685


#: Chunks whose words a task sorts at once, words whose stems a worker remembers.
AT_ONCE, REMEMBERED = 4096, 500_000


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array's values begin, and its end."""
    return np.append(np.flatnonzero(np.diff(x, prepend=x[:1] - 1)), len(x)).astype(np.int32)


@cache
def _signs() -> np.ndarray:
    """For each code point, whether it is a letter or digit."""
    return np.array([unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)])


def _words(texts: pa.BinaryArray) -> tuple[np.ndarray, pa.BinaryArray]:
    """How many words each text of UTF-8 bytes has, and all of them: runs of letters and digits."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    d = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    signs = _signs()
    within = signs[:128][np.minimum(d, 127)] & (d < 128)
    at = np.flatnonzero(d >= 0xC0)
    if len(at):
        size = 2 + (d[at] >= 0xE0) + (d[at] >= 0xF0)
        code = (d[at] & (0xFF >> (size + 1))).astype(np.int64)
        for i in (1, 2, 3):
            code = np.where(size > i, code << 6 | d[np.minimum(at + i, len(d) - 1)] & 0x3F, code)
        good = signs[np.minimum(code, 0x10FFFF)]
        for i in range(4):
            own = at[(size > i) & good] + i
            within[own[own < len(d)]] = True
    # A word ends with its text.
    edge = np.zeros(len(d) + 1, bool)
    edge[bounds] = True
    begin = np.flatnonzero(within & (edge[:-1] | ~np.concatenate([[False], within[:-1]])[: len(d)]))
    end = np.flatnonzero(within & (edge[1:] | ~np.concatenate([within[1:], [False]])[: len(d)])) + 1
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    sizes = np.diff(np.searchsorted(begin, bounds))
    return sizes, pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(d[within])])


def _postings(b: pa.RecordBatch, terms: dict[str, str | None]) -> pa.RecordBatch:
    """The rows of :func:`index` of some chunks with their text's bytes; ``terms`` remembers stems, none for stop words."""
    sizes, words = _words(b.column(3))
    coded = words.dictionary_encode()
    known = [w.decode("utf-8", "replace") for w in coded.dictionary.to_pylist()]
    for w in known:
        if w not in terms:
            terms[w] = stem_word(w)
    number: dict[str, int] = {}
    of = np.array([-1 if terms[w] is None else number.setdefault(terms[w], len(number)) for w in known], np.int64)
    row = np.repeat(np.arange(len(b)), sizes)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1).astype(np.int32)
    term = of[coded.indices.to_numpy(zero_copy_only=False)]
    kept = np.flatnonzero(term >= 0)
    code = lambda i: b.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.unique(code(0) * len(b) + code(1), return_inverse=True)[1]
    key = (base[row[kept]] * len(number) + term[kept]) * len(b) + row[kept]
    order = np.argsort(key, kind="stable")  # places stay in their order
    key = key[order]
    one = _starts(key)  # a term in a chunk
    first = key[one[:-1]]
    whole = _starts(first // len(b))  # a term in a knowledge base
    at = pa.array(first[whole[:-1]] % len(b))
    names = pa.array(list(number), pa.string()).take(pa.array(first[whole[:-1]] // len(b) % max(1, len(number))))
    ends = one[1:] - np.repeat(one[whole[:-1]], np.diff(whole))
    lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), x)
    chunks = lists(whole, b.column(2).take(pa.array(first % len(b))))
    return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), names, chunks, lists(whole, pa.array(ends, pa.int32())), lists(one[whole], pa.array(place[kept][order]))], names=COLUMNS)


COLUMNS = [*KB, "term", "chunk_ids", "ends", "places"]


def index(chunks: DataFrame) -> DataFrame:
    """``user_id, kb_id, term, chunk_ids, ends, places`` of ``chunks`` (``chunk_id, user_id, kb_id, text``).

    A word is a run of letters and digits of any script, in lower case; places count all
    words from 1, stop words too, which aren't indexed. Null texts have no rows. One Arrow
    pass over bytes without a shuffle, in which each distinct word is stemmed once a worker: a term has a
    row for a knowledge base and some thousand chunks, with the chunks that hold it, all its
    places and where each chunk's end among them. Readers merge what stands on several rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = dict.fromkeys(STOPWORDS)
        for whole in batches:
            for i in range(0, len(whole), AT_ONCE):
                if len(terms) > REMEMBERED:
                    terms = dict.fromkeys(STOPWORDS)
                yield _postings(whole.slice(i, AT_ONCE), terms)

    w = chunks.where("text is not null").select(*KB, "chunk_id", F.encode(F.lower("text"), "UTF-8").alias("bytes"))
    kinds = dict(zip(COLUMNS, [*(w.schema[k].dataType for k in KB), StringType(), ArrayType(w.schema["chunk_id"].dataType), ArrayType(IntegerType()), ArrayType(IntegerType())], strict=True))
    return w.mapInArrow(run, StructType([StructField(c, k) for c, k in kinds.items()]))


def _shard(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def save(ix: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write an index; a shard's files are sorted by term, so that a reader skips what its terms aren't in."""
    s = ix.withColumn("shard", _shard(F.col("term"), shards))
    # A frequent term is dealt to several tasks.
    s = s.repartition("shard", F.pmod(F.xxhash64("chunk_ids"), F.lit(4))).sortWithinPartitions("shard", "term")
    s.write.mode("overwrite").partitionBy("shard").parquet(path)
    ix.sparkSession.createDataFrame([(shards,)], "shards int").coalesce(1).write.mode("overwrite").json(f"{path}.meta")


class Saved:
    """A saved index."""

    def __init__(self, spark: SparkSession, path: str):
        self.shards = spark.read.schema("shards int").json(f"{path}.meta").first()[0]
        self.rows = spark.read.schema("user_id string, kb_id string, term string, chunk_ids array<long>, ends array<int>, places array<int>, shard int").parquet(path)
        self.spark = spark

    def of(self, terms: list[str]) -> DataFrame:
        """``user_id, kb_id, term, chunk_id, positions`` of some terms; chunks that share an id have a row each."""
        own = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_shard(F.col("term"), self.shards)).distinct().collect() if terms else []
        rows = self.rows.where(F.col("shard").isin([r[0] for r in own]) & F.col("term").isin(terms))
        start = "if(i = 0, 0, ends[i - 1])"
        return rows.select(*KB, "term", F.expr(f"inline(transform(chunk_ids, (c, i) -> named_struct('chunk_id', c, 'positions', slice(places, {start} + 1, ends[i] - {start}))))"))


def parse(spark: SparkSession, q: str) -> list[list[tuple[bool, list[tuple[int, str]]]]]:
    """Alternatives of a web-style query, each a list of ``(negated, [(offset, term)])`` that must all hold.

    ``or`` parts alternatives and binds less than standing side by side; ``-`` negates a word
    or phrase; words in quotes stand at their distances. Stop words go, but count as places in
    a phrase. A word of several parts (``a-b``) is a phrase.
    """
    parts: list[list[tuple[bool, list[tuple[int, str]]]]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', q.lower()):
        if word == "or" and not minus:
            parts.append([])
            continue
        found = re.findall(r"[^\W_]+", quoted or word)
        kept = [(i, w) for i, w in enumerate(found) if w not in STOPWORDS]
        if kept:
            parts[-1].append((bool(minus), [(i - kept[0][0], w) for i, w in kept]))
    words = sorted({w for p in parts for _, e in p for _, w in e})
    if words:
        rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", stem("word").alias("term")).collect()
        terms = {r.word: r.term for r in rows}
        parts = [[(n, [(i, terms[w]) for i, w in e]) for n, e in p] for p in parts]
    return [p for p in parts if p]


def _distance(d: Column) -> Column:
    """How much two words so far apart count together."""
    return F.when(d > 100, F.lit(1e-30)).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2.0)))


def _gaps(one: Column, two: Column) -> Column:
    return F.transform(one, lambda x: F.transform(two, lambda y: F.abs(x - y)))


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _rank(terms: list[str], together: bool) -> Column:
    """By its places' number where words are alternatives, by the nearness of words where they must stand together."""
    place = [F.col(f"`p{i}`") for i in range(len(terms))]
    if together and len(terms) > 1:
        rest = F.lit(1.0)
        for i in range(len(terms)):
            for k in range(i):
                pairs = F.flatten(_gaps(place[i], place[k]))
                miss = F.aggregate(F.filter(pairs, lambda d: d > 0), F.lit(1.0), lambda acc, d: acc * (1.0 - WEIGHT * F.sqrt(_distance(d.cast("double")))))
                rest = rest * F.coalesce(miss, F.lit(1.0))
        return F.lit(1.0) - rest
    total = F.lit(0.0)
    for p in place:
        series = F.aggregate(F.transform(p, lambda _, i: 1.0 / ((i + 1) * (i + 1)).cast("double")), F.lit(0.0), lambda acc, x: acc + x)
        total = total + F.coalesce(series, F.lit(0.0)) * F.lit(WEIGHT / LIMIT)
    return total / F.lit(float(max(1, len(terms))))


def search(saved: Saved, q: str, chunks: DataFrame | None = None) -> DataFrame:
    """``user_id, kb_id, chunk_id, score`` of the chunks that match; an empty query matches none.

    A query with an alternative of negations only needs ``chunks``, since what it matches may
    have none of its terms.
    """
    parts = parse(saved.spark, q)
    terms = sorted({t for p in parts for _, e in p for _, t in e})
    found = saved.of(terms).groupBy(*KB, "chunk_id").agg(*(F.sort_array(F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("positions"))))).alias(f"p{i}") for i, t in enumerate(terms)), F.count("*").alias("_n"))
    if any(all(n for n, _ in p) for p in parts):
        if chunks is None:
            raise ValueError("a query of negations only needs the chunks")
        found = chunks.select(*KB, "chunk_id").join(found, [*KB, "chunk_id"], "left")
    at = {t: F.col(f"`p{i}`") for i, t in enumerate(terms)}

    def holds(element: list[tuple[int, str]]) -> Column:
        first = at[element[0][1]]
        for offset, t in element[1:]:
            first = F.array_intersect(first, _moved(at[t], offset))
        return F.coalesce(F.size(first) > 0, F.lit(False))

    match = F.lit(False)
    for p in parts:
        every = F.lit(True)
        for negated, element in p:
            every = every & (~holds(element) if negated else holds(element))
        match = match | every
    together = len(parts) == 1
    return found.where(match).select(*KB, "chunk_id", _rank(terms, together).alias("score"))


def top(saved: Saved, q: str, k: int) -> DataFrame:
    """The ``k`` best of each knowledge base with their ``rank``; equal scores go by id."""
    s = search(saved, q).withColumn("score", F.round("score", 9))
    w = Window.partitionBy(*KB).orderBy(F.desc("score"), "chunk_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: The rules in SQL, for checks.
INDEX_SQL = f"""
words AS (SELECT user_id, kb_id, chunk_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM (SELECT user_id, kb_id, chunk_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM passages) AS q),
stems AS MATERIALIZED (SELECT word, {stem_sql('word', duckdb=True)} AS term FROM (SELECT DISTINCT word FROM words) AS q WHERE word NOT IN ({', '.join(f"'{s}'" for s in STOPWORDS)})),
posting AS MATERIALIZED (SELECT user_id, kb_id, term, chunk_id, list(p ORDER BY p) AS positions FROM words JOIN stems USING (word) GROUP BY ALL)"""
