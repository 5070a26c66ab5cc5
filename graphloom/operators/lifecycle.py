"""Job states, quotas, pagination, sessions, turns and counters as set operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("pending", "processing")
STAGES_TEXT = ["scanning", "embedding", "entities", "complete"]
STAGES_LAYOUT = ["scanning", "analyzing", "embedding", "entities", "complete"]


def page(df: DataFrame, order: list[str], cursor: tuple | None = None, limit: int = 50, most: int = 200) -> DataFrame:
    """The page after ``cursor`` (values of ``order``) with ``has_more``; without a cursor, the first."""
    limit = min(limit if limit > 0 else 50, most)
    if cursor is not None:
        after = F.lit(False)
        for i in range(len(order) - 1, -1, -1):
            c = F.col(order[i])
            after = (c > F.lit(cursor[i])) | ((c == F.lit(cursor[i])) & after)
        df = df.where(after)
    rows = df.orderBy(*order).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("n", n).withColumn("has_more", F.max("n").over(Window.partitionBy()) > limit).where(F.col("n") <= limit).drop("n")


def stage_of(job_type: Column, phase: Column) -> Column:
    """The display stage of a job."""
    return (
        F.when((job_type == "region_classification") & (phase == "embedding"), "embedding").when(job_type == "region_classification", "analyzing")
        .when(job_type == "document_indexing", "embedding").when(job_type.isin("entity_extraction", "edge_extraction", "canonicalization"), "entities")
        .when(job_type == "malware_scan", "scanning").otherwise("processing")
    )


def active_stages(jobs: DataFrame) -> DataFrame:
    """``document_id, has_layout, stages``: distinct stages of active jobs in pipeline order."""
    live = jobs.where(F.col("status").isin(*ACTIVE)).withColumn("stage", stage_of(F.col("job_type"), F.col("phase")))
    order = F.when(F.col("has_layout"), F.array(*map(F.lit, STAGES_LAYOUT))).otherwise(F.array(*map(F.lit, STAGES_TEXT)))
    g = live.groupBy("document_id", "has_layout").agg(F.collect_set("stage").alias("present"))
    return g.select("document_id", "has_layout", F.array_intersect(order, "present").alias("stages"))


def ring(status: Column, stages: Column, active: Column) -> Column:
    """How far a document is, 0 to 1: the middle of its earliest active stage."""
    at = F.array_position(stages, F.element_at(F.array_intersect(stages, active), 1))
    none = active.isNull() | (F.size(F.array_intersect(stages, active)) == 0)
    return F.when(status.isin("indexed", "failed"), 1.0).when(stages.isNull() | (F.size(stages) == 0), F.when(status == "pending", 0.0).otherwise(0.5)).when(none, 0.0).otherwise((at - 0.5) / F.size(stages))


def stage_states(stages: Column, active: Column) -> Column:
    """Each stage with its state: active, done (before the earliest active one) or upcoming."""
    first = F.array_position(stages, F.element_at(F.array_intersect(stages, active), 1))
    some = F.size(F.array_intersect(stages, active)) > 0
    return F.transform(stages, lambda s, i: F.concat(s, F.lit(":"), F.when(F.array_contains(active, s), "active").when(some & (i + 1 < first), "done").otherwise("upcoming")))


def session_state(now: Column, created: Column, seen: Column, warned: Column) -> Column:
    """expired after 24 hours or 6 idle ones; warn within 15 minutes of either, once."""
    end = F.least(created + F.expr("interval 24 hours"), seen + F.expr("interval 6 hours"))
    return F.when(now >= end, "expired").when((now >= end - F.expr("interval 15 minutes")) & ~warned, "warn").otherwise("live")


def resolve_region(needs: Column, kind: Column, text: Column) -> tuple[Column, Column]:
    """Type and status of a layout region."""
    t = F.when(needs == "describe", "figure").when((needs == "confirm_scan") & (kind == "unconfirmed_table"), "scanned_table").when(needs == "confirm_scan", "scanned_text").when(kind == "native_table", "native_table").otherwise("native_text")
    s = F.when(F.coalesce(needs, F.lit("")).isin("describe", "confirm_scan"), "skipped").when(text != "", "indexed").otherwise("skipped")
    return t, s


def allowed_window(df: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Fixed-window limiter over events (``key, id, ts``): a window opens at its first event and is over strictly after its end; ``key, id, allowed``.

    Events pass in order of key and time, and a task keeps the open window only. Where a
    window ends is searched in the sorted times, so a key costs its windows, not its events.
    """
    width = seconds * 1_000_000
    key_type, id_type = df.schema["key"].dataType.simpleString(), df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end, n = None, None, 0
        for batch in batches:
            if not len(batch):
                continue
            keys, times = batch.column(0), batch.column(2).to_numpy()
            code = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False) if keys.null_count == 0 else np.array(pc.fill_null(keys.dictionary_encode().indices, -1))
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            ok = np.empty(len(batch), bool)
            for i, stop in zip(first.tolist(), np.append(first[1:], len(batch)).tolist(), strict=True):
                own = (keys[i].as_py(),)
                if own != last:
                    last, end, n = own, None, 0
                while i < stop:
                    if end is None or end < times[i]:
                        end, n = int(times[i]) + width, 0
                    j = i + int(np.searchsorted(times[i:stop], end, "right"))
                    ok[i:j] = np.arange(n + 1, n + 1 + j - i) <= limit
                    n, i = n + j - i, j
            yield pa.RecordBatch.from_arrays([keys, batch.column(1), pa.array(ok)], names=["key", "id", "allowed"])

    e = df.where("ts is not null").select("key", "id", F.unix_micros("ts").alias("t"))
    return e.repartition("key").sortWithinPartitions("key", "t", "id").mapInArrow(run, f"key {key_type}, id {id_type}, allowed boolean")


def turns(messages: DataFrame) -> DataFrame:
    """``conv_id, root, query, answers``: answers by the root of their chain of replacements, then unanswered queries.

    Chains are followed by pointer jumping, so their length costs its logarithm in joins.
    """
    from ..sources.lineage import cut

    w = Window.partitionBy("conv_id").orderBy("ordinal")
    m = messages.withColumn("prev_role", F.lag("role").over(w)).withColumn("prev_id", F.lag("message_id").over(w))
    a = m.where("role = 'assistant'")
    up = a.select("message_id", F.coalesce("supersedes", "message_id").alias("root"))
    # Twice as far each round; a chain that comes back to itself would go on for ever without the bound.
    for _ in range(a.count().bit_length() + 1):
        far = up.join(up.select(F.col("message_id").alias("root"), F.col("root").alias("above")), "root", "left").select("message_id", F.col("root").alias("before"), F.coalesce("above", "root").alias("root"))
        far = cut(far)
        up = far.select("message_id", "root")
        if far.where("root <> before").isEmpty():
            break
    roots = a.where("supersedes is null").select(F.col("message_id").alias("root"), F.when(F.col("prev_role") == "user", F.col("prev_id")).alias("query"))
    known = a.join(up, "message_id").join(roots.select("root", F.lit(True).alias("known")), "root", "left")
    # An answer whose chain leaves the conversation is a turn of its own.
    known = known.withColumn("root", F.when(F.col("known"), F.col("root")).otherwise(F.col("message_id")))
    g = known.groupBy("conv_id", "root").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("supersedes").isNotNull().alias("later"), "ordinal", "message_id"))), lambda x: x["message_id"]).alias("answers"))
    out = g.join(roots, "root", "left")
    asked = m.where("role = 'user'").select("conv_id", F.col("message_id").alias("query")).join(roots.where("query is not null").select("query"), "query", "left_anti")
    return out.select("conv_id", "root", "query", "answers").unionByName(asked.select("conv_id", F.lit(None).cast("long").alias("root"), "query", F.array().cast("array<bigint>").alias("answers")))


#: SQLSTATE classes of errors that a retry can't mend (bad data, broken constraint, bad statement).
DETERMINISTIC = ["22", "23", "42"]


def error_class(sqlstate: Column) -> Column:
    """``deterministic`` for errors that would come again (the row belongs in quarantine), ``transient`` for all others, also those without a state."""
    return F.when(F.left(sqlstate, F.lit(2)).isin(DETERMINISTIC), "deterministic").otherwise("transient")


def publish(jobs: DataFrame, requests: DataFrame, undelivered: DataFrame) -> DataFrame:
    """The records of ``requests`` (distinct keys) after their publication: ``user_id, document_id, job_type, attempt, status, started, error``.

    A job without a record starts at attempt 1, a finished one anew, an active one stays as
    it is and isn't dispatched. A started attempt in ``undelivered`` (keys and ``reason``) fails at once,
    so that it doesn't stand as pending with nothing running it.
    """
    key = ["user_id", "document_id", "job_type"]
    j = requests.select(*key).distinct().join(jobs.select(*key, F.col("status").alias("was"), F.col("attempt").alias("last"), F.col("error").alias("old")), key, "left")
    j = j.join(undelivered.select(*key, "reason"), key, "left")
    started = F.col("was").isNull() | ~F.col("was").isin(*ACTIVE)
    lost = started & F.col("reason").isNotNull()
    return j.select(
        *key, F.when(started, F.coalesce("last", F.lit(0)) + 1).otherwise(F.col("last")).alias("attempt"), F.when(lost, "failed").when(started, "pending").otherwise(F.col("was")).alias("status"),
        started.alias("started"), F.when(lost, F.col("reason")).when(started, "").otherwise(F.coalesce("old", F.lit(""))).alias("error"),
    )


def _busy(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*ACTIVE)).select("document_id").distinct().withColumn("_busy", F.lit(True))


def retry_guard(documents: DataFrame, jobs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``document_id, verdict``: ``retry`` resets a document to pending; else why it can't be (``not_failed``, ``busy``, ``rejected``)."""
    d = documents.join(_busy(jobs), "document_id", "left").join(rejected.select("document_id").distinct().withColumn("_bad", F.lit(True)), "document_id", "left")
    verdict = F.when(~F.col("status").eqNullSafe("failed"), "not_failed").when(F.col("_busy"), "busy").when(F.col("_bad"), "rejected").otherwise("retry")
    return d.select("document_id", verdict.alias("verdict"))


def reextract_guard(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """``document_id, verdict``: ``reextract``, or ``not_indexed`` or ``busy``."""
    d = documents.join(_busy(jobs), "document_id", "left")
    return d.select("document_id", F.when(~F.col("status").eqNullSafe("indexed"), "not_indexed").when(F.col("_busy"), "busy").otherwise("reextract").alias("verdict"))


def update_status(documents: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with the status of ``updates`` (``user_id, document_id, new_status``; one row a document), and the updates that found none of that tenant."""
    key = ["user_id", "document_id"]
    out = documents.join(updates.select(*key, "new_status"), key, "left").withColumn("status", F.coalesce("new_status", "status")).select(*documents.columns)
    return out, updates.join(documents.select(*key), key, "left_anti")


def get_or_create(inquiries: DataFrame, asked: DataFrame) -> DataFrame:
    """One inquiry for each ``user_id, kb_id`` of ``asked``: the one there is, or a new one (``created``) whose id is a hash of both."""
    key = ["user_id", "kb_id"]
    j = asked.select(*key).distinct().join(inquiries.select(*key, "inquiry_id"), key, "left")
    return j.select(*key, F.coalesce("inquiry_id", F.xxhash64(*key)).alias("inquiry_id"), F.col("inquiry_id").isNull().alias("created"))
