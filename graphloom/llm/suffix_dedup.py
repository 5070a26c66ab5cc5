"""Suffix-array dedup by distributed rank refinement, over the bytes of whole texts.

A byte is removed if a string of ``length`` bytes that covers it also starts in a document
with a smaller id. Only positions that can matter are ranked. Every window of ``length``
bytes is named by its minimizer, the leftmost string of 24 bytes in it whose first
eight bytes hash lowest, so equal windows have equal minimizers at equal places. A
minimizer that one document alone holds leaves; one whose whole surroundings a smaller
document holds too is decided.

The minimizers left are ranked by growing strings around them. A round sorts pairs of the
rank so far and the bytes that the strings gain (for few bytes, their own order is their
rank), and the place of a group's head in the sorted order is its new rank. Ranks
cover what the windows that hold the minimizer at 16, then at 4 and at last at one
neighbouring place have in common: 35, 47 and 50 bytes for a ``length`` of 50. After each round, groups
of one document leave, and members whose whole windows a smaller document has are decided.

Ranks of all windows at doubling offsets would need a row for every window and half; on
the tables here that is several times the rows of all rounds together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packed
from .kernels import U64, loads, mix, text_slices
from .storage import discard, materialize, materialize_buckets

#: Neighbouring places of a minimizer that share a rank, round by round.
STEPS = (16, 4, 1)
#: Rows of minimizers that a task combines before they are shuffled.
COMBINED = 1_000_000
#: Rows of one minimizer that a task sends on to be judged; more of them are open without being judged, which the rounds mend.
WITNESSES = 64
_C = [U64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2545F4914F6CDD1D)]
_KINDS = (U64, U64, np.int64, np.int32, np.int64, np.int8)
_SENT, _DECIDED, _OPEN = 0, 1, 2


def gram_size(length: int) -> int:
    return 24 if length >= 48 else 16


def _spread(m: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, span: int) -> np.ndarray:
    """64-bit names of ``size`` bytes (``length`` at least, less than ``length + span``) from each start; ``m`` has the mixed eight bytes of each place."""
    out = size.astype(U64) * _C[9]
    for k in range(length // 8):
        out += (m[start + 8 * k] ^ _C[k % 9]) * _C[(k + 3) % 11]
    out = mix(out)
    end = start + size
    for k in range(1, -(-(span + 7) // 8) + 1):  # what the words from the start on leave
        out += (m[end - 8 * k] ^ _C[k % 11]) * _C[(k + 5) % 11]
    return mix(out)


def minimizers(offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(first window, windows, minimizer's place behind it, its name, name of all bytes of those windows)`` of each run of windows with one minimizer."""
    n, span = len(data), length - gram + 1
    windows = n - length + 1
    if windows <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    m = mix(loads(data)[:n])
    low = (m[: n - gram + 1] & U64(0xFFFFFFFF00000000)) | np.arange(n - gram + 1, dtype=U64)
    have = 1
    while have * 2 <= span:  # the place in the low half makes the leftmost of equals the smallest
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    where = (low[:windows] & U64(0xFFFFFFFF)).astype(np.int64)
    long = np.diff(offsets) >= length
    first = offsets[:-1][long]
    mark = np.zeros(n + 1, np.int32)
    mark[first] += 1
    np.add.at(mark, offsets[1:][long] - length + 1, -1)
    inside = np.cumsum(mark[:windows]) > 0
    change = np.empty(windows, bool)
    change[0] = True
    change[1:] = (where[1:] != where[:-1]) | (inside[1:] != inside[:-1])
    change[first] = True
    start = np.flatnonzero(change)
    stop = np.append(start[1:], windows)
    keep = inside[start]
    start, stop = start[keep], stop[keep]
    at = where[start]
    name = mix(sum((m[at + 8 * k] * _C[k] for k in range(gram // 8)), np.zeros(len(at), U64)))
    around = _spread(m, start, stop - 1 + length - start, length, span) ^ mix((at - start).astype(U64) << U64(16) | (stop - start).astype(U64))
    return start, stop - start, at - start, name, around


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Mask of the rows that differ from the row before in any of the columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _judged(name: np.ndarray, around: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(decided, open)`` of all rows of some minimizers.

    Decided: a smaller document has the same surroundings. Open: the others of a minimizer
    with several documents and several surroundings.
    """
    decided, open_ = np.zeros(len(name), bool), np.zeros(len(name), bool)
    order = np.argsort(name)
    new = _groups(name[order])
    at = np.flatnonzero(new)
    if not len(at):
        return decided, open_
    d = doc[order]
    shared = np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)
    rows = order[shared[np.cumsum(new) - 1]]
    rows = rows[np.lexsort((doc[rows], around[rows], name[rows]))]
    if not len(rows):
        return decided, open_
    new, new_around = _groups(name[rows]), _groups(name[rows], around[rows])
    later = doc[rows] > doc[rows][np.flatnonzero(new_around)][np.cumsum(new_around) - 1]
    several = np.add.reduceat(new_around, np.flatnonzero(new), dtype=np.int64) > 1
    decided[rows[later]] = True
    open_[rows] = ~later & several[np.cumsum(new) - 1]
    return decided, open_


def _combined(name: np.ndarray, around: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """What becomes of the rows of one task: sent on, decided, or open.

    Copies of surroundings that a smaller document of the task has are decided here. Of a
    minimizer with many rows left in several documents, so many go on as show the others
    that it is shared; the rest is open, since no group can leave by it.
    """
    kind = np.full(len(name), _SENT, np.int8)
    order = np.argsort(name)
    same = np.zeros(len(name) + 1, bool)
    same[1:-1] = name[order][1:] == name[order][:-1]
    rows = order[same[1:] | same[:-1]]
    decided, open_ = _judged(name[rows], around[rows], doc[rows])
    kind[rows[decided]] = _DECIDED
    rows = rows[open_]
    rows = rows[np.lexsort((doc[rows], name[rows]))]
    new = _groups(name[rows])
    at = np.flatnonzero(new)
    place = np.arange(len(rows)) - at[np.cumsum(new) - 1] if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(rows)))
    last = place == size[np.cumsum(new) - 1] - 1 if len(at) else np.zeros(0, bool)
    # The last row is of another document than the first, so that both bear witness.
    kind[rows[(place >= WITNESSES) & ~last]] = _OPEN
    return kind


def _positions(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """Packed rows ``name, around, doc, tag, place, kind`` of the minimizers; place is ``first window << 16 | windows << 8 | minimizer behind it``."""
    gram = gram_size(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            name, around, doc, tag, place = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            kind = _combined(name, around, doc)
            # What needn't meet is dealt by the row.
            name = np.where(kind == _SENT, name, mix(place.view(U64) + doc.view(U64)))
            yield from packed.pack([name, around, doc, tag, place, kind], buckets)

        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row0, offsets, data in text_slices(batch.column(2)):
                start, count, behind, name, around = minimizers(offsets, data, length, gram)
                row = np.searchsorted(offsets, start, "right") - 1
                held.append([name, around, doc[row0 + row], tag[row0 + row], (start - offsets[row]) << 16 | count << 8 | behind])
                if sum(len(h[0]) for h in held) >= COMBINED:
                    yield from flush()
        if held:
            yield from flush()

    return texts.select("doc", "tag", "text").mapInArrow(run, packed.SCHEMA)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed rows to ``doc, tag, place, rank, open`` of those that are decided or open."""
    for name, around, doc, tag, place, kind in packed.gather(batches, _KINDS):
        decided, open_ = kind == _DECIDED, kind == _OPEN
        sent = np.flatnonzero(kind == _SENT)
        yes, maybe = _judged(name[sent], around[sent], doc[sent])
        decided[sent[yes]] = True
        open_[sent[maybe]] = True
        rows = np.flatnonzero(decided | open_)
        for a in range(0, len(rows), 100_000):
            r = rows[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(tag[r]), pa.array(place[r]), pa.array(open_[r])], names=["doc", "tag", "place", "open"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``doc, tag, text, places`` to ``doc, tag, start, behind, bytes``: the bytes of each open run of windows."""
    for batch in batches:
        for row0, offsets, data in text_slices(batch.column(2)):
            raw = data.tobytes()
            for i in range(len(offsets) - 1):
                places = np.unique(batch.column(3)[row0 + i].values.to_numpy())
                start, size = places >> 16, (places >> 8 & 0xFF) + length - 1
                base = int(offsets[i])
                for a in range(0, len(places), 20_000):
                    s = slice(a, a + 20_000)
                    k = len(places[s])
                    parts = [raw[base + x : base + x + n] for x, n in zip(start[s].tolist(), size[s].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, batch.column(0)[row0 + i].as_py())), pa.array(np.full(k, batch.column(1)[row0 + i].as_py(), np.int32)), pa.array(start[s]), pa.array((places[s] & 0xFF).astype(np.int32)), pa.array(parts, pa.binary())], names=["doc", "tag", "start", "behind", "bytes"])


def refine(runs: DataFrame, step: int, before: int, length: int) -> DataFrame:
    """One round: ``doc, tag, start, windows, open, rank, behind, bytes`` of the parts of ``runs`` that are decided or open.

    ``runs`` has ``rank, doc, tag, start, behind, bytes``: a run of windows, the minimizer
    ``behind`` bytes after the first one. A run is cut where the minimizer's place passes a
    multiple of ``step``. All windows of a part hold the same string around the minimizer;
    its rank comes from a sort by the rank of the string before (which ``before``
    neighbouring places share, 0 for none) and the bytes that it gains.
    """
    span = length - gram_size(length) + 1
    r = runs.withColumn("_least", F.expr(f"behind - (octet_length(bytes) - {length})"))
    r = r.withColumn("_part", F.explode(F.expr(f"sequence(int(_least div {step}), int(behind div {step}))")))
    r = r.withColumn("_lo", F.expr(f"_part * {step}")).withColumn("_hi", F.expr(f"least(_lo + {step}, {span})"))
    r = r.withColumn("_most", F.expr("least(behind, _hi - 1)")).withColumn("_down", F.expr("greatest(_least, _lo)"))
    if before:
        up = f"int(behind div {before}) * {before}"  # a run's places share one part of the round before
        gain = f"concat(substring(bytes, behind - _lo + 1, _lo - {up}), substring(bytes, behind + {length} - least({up} + {before}, {span}) + 2, least({up} + {before}, {span}) - _hi))"
    else:
        gain = f"substring(bytes, behind - _lo + 1, _lo + {length} - _hi + 1)"
    r = r.withColumn("_gain", F.expr(gain))
    r = r.select(
        "rank", "_part", "_gain", "doc", "tag", F.expr("start + behind - _most").alias("start"), F.col("_most").cast("int").alias("behind"),
        F.expr(f"substring(bytes, behind - _most + 1, _most - _down + {length})").alias("bytes"),
    )
    group = ["rank", "_part", "_gain"] if before else ["_gain", "_part", "rank"]
    around = ["behind", "bytes"] if step > 1 else []
    r = r.repartition(*group).sortWithinPartitions(*group, *around, "doc").withColumn("_id", F.monotonically_increasing_id())
    # The sort above serves both windows.
    low = Window.partitionBy(*group, *around)
    string = Window.partitionBy(*group)
    r = r.withColumn("_low", F.min("doc").over(low))
    r = r.withColumn("_first", F.min("doc").over(string)).withColumn("_last", F.max("doc").over(string)).withColumn("_head", F.min("_id").over(string))
    decided = F.col("doc") > F.col("_low")
    r = r.where("_first < _last").where(decided if step == 1 else F.lit(True))
    return r.select(
        "doc", "tag", "start", F.expr(f"octet_length(bytes) - {length - 1}").alias("windows"), (~decided).alias("open"),
        F.col("_head").alias("rank"), "behind", F.when(~decided, F.col("bytes")).alias("bytes"),
    )


def repeated_bytes(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Null texts count as empty, and matches never cross documents. Rows of equal id aren't
    smaller than one another, so they leave each other alone. A row with a null id neither
    loses bytes nor takes any. ``length`` lies between 32 and 240. An empty table gives an
    empty result. A text is held whole by one task, with about forty bytes a byte of it.
    """
    if not 32 <= length <= 240:
        raise ValueError("length must lie between 32 and 240")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    every = docs.select(F.col("doc_id").cast("long").alias("doc"), F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    every = every.withColumn("rid", F.xxhash64("doc", "sha"))
    ids = materialize(every.select("doc", "sha", "n", "rid"), "ids")
    # Of equal texts, only the one with the smallest id can hold anything that isn't decided already.
    least = ids.where("doc is not null").groupBy("sha").agg(F.min("doc").alias("least"))
    first = ids.where(F.col("n") >= length).join(least, "sha").where("doc = least").select("rid", "doc", F.col("sha").alias("_sha")).distinct()
    # Texts of one id are numbered; the number takes less room than a hash where rows are many.
    first = materialize(first.withColumn("tag", F.row_number().over(Window.partitionBy("doc").orderBy("_sha")) - 1), "first")
    named = first.select("doc", "tag", "rid")
    texts = every.where((F.col("n") >= length) & F.col("doc").isNotNull()).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid", "doc")
    texts = materialize_buckets(texts.join(first, ["rid", "doc"]).where("sha = _sha").select("doc", "rid", "tag", "text"), ["rid", "doc"], "texts")
    size = ids.agg(F.sum("n")).first()[0] or 0
    rows = _positions(texts, length, packed.bucket_count(size)).repartition("bucket")
    judged = materialize(rows.mapInArrow(_judge, "doc long, tag int, place long, open boolean"), "judged")
    places = judged.where("open").groupBy("doc", "tag").agg(F.collect_list("place").alias("places")).join(named, ["doc", "tag"])
    found = texts.drop("tag").join(places, ["rid", "doc"]).select("doc", "tag", "text", "places")
    runs = found.mapInArrow(lambda b: _contexts(b, length), "doc long, tag int, start long, behind int, bytes binary")
    # The first strings contain the minimizer itself, so nothing rests on its name.
    runs = runs.withColumn("rank", F.lit(0).cast("long"))
    gone = [judged.where("not open").select("doc", "tag", F.shiftright("place", 16).alias("start"), F.shiftright("place", 8).bitwiseAND(0xFF).cast("int").alias("windows"))]
    before, tables = 0, []
    for step in STEPS:
        level = materialize(refine(runs, step, before, length), "ranks")
        gone.append(level.where("not open").select("doc", "tag", "start", "windows"))
        runs, before = level.where("open").select("rank", "doc", "tag", "start", "behind", "bytes"), step
        tables.append(level)
    gone = reduce(DataFrame.unionByName, gone).groupBy("doc", "tag").agg(F.collect_list("start").alias("w"), F.collect_list("windows").alias("c")).join(named, ["doc", "tag"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, digests = [], [], []
            for _, offsets, data in text_slices(batch.column(2)):
                for i in range(len(offsets) - 1):
                    k = len(removed)
                    body = data[offsets[i] : offsets[i + 1]]
                    w, c = batch.column(3)[k].values.to_numpy(), batch.column(4)[k].values.to_numpy()
                    mark = np.zeros(len(body) + 1, np.int32)
                    np.add.at(mark, w, 1)
                    np.add.at(mark, w + c - 1 + length, -1)
                    off = np.cumsum(mark[:-1]) > 0
                    removed.append(int(off.sum()))
                    spans.append(int((off & ~np.r_[False, off[:-1]]).sum()))
                    digests.append(hashlib.sha256(body[~off].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=["doc", "rid", "n_removed", "n_spans", "kept"])

    done = texts.drop("tag").join(gone, ["rid", "doc"]).select("doc", "rid", "text", "w", "c")
    done = materialize(done.mapInArrow(cut, "doc long, rid long, n_removed long, n_spans long, kept string").dropDuplicates(["rid", "doc"]), "cut")
    for t in (texts, judged, *tables):
        discard(t)
    out = ids.join(least, "sha", "left").join(done, ["rid", "doc"], "left")
    copy = (F.col("n") >= length) & (F.col("least") < F.col("doc"))
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
