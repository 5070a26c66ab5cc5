"""Structured Streaming forms of the incremental stages."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.blocks import FooterFilter
from ..sources.lineage import shared_folder

ACTIVE = ("pending", "processing")


def enqueue(status: str | None, attempt: int) -> tuple[str, int, bool]:
    """``(status, attempt, started)``: a new job starts at 1, a finished one anew, an active one stays."""
    if status is None:
        return "pending", 1, True
    if status in ACTIVE:
        return status, attempt, False
    return "pending", attempt + 1, True


def transition(status: str, attempt: int, of: int, to: str, phase: str = "", error: str = "", new_phase: str = "", reason: str = "") -> tuple[str, str, str, str]:
    """``(status, phase, error, outcome)``; the outcome is changed, same, superseded, not_active or invalid.

    An empty new phase keeps the old one. Success clears phase and error; a failure keeps the
    phase and records its reason, the first one if it is reported again.
    """
    if of != attempt:
        return status, phase, error, "superseded"
    if to not in ("processing", "succeeded", "failed"):
        return status, phase, error, "invalid"
    if status not in ACTIVE:
        return status, phase, error, "same" if status == to else "not_active"
    if to == "processing":
        then = (to, new_phase or phase, error)
    elif to == "succeeded":
        then = (to, "", "")
    else:
        then = (to, phase, reason)
    return *then, "same" if then == (status, phase, error) else "changed"


def _in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All rows that one micro-batch has of a key, sorted; Spark hands them over in Arrow batches of no order.

    The source's limit on a micro-batch (files or bytes a trigger) bounds what is held.
    """
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable")


def rate_limited(events: DataFrame, limit: int = 100, seconds: float = 60.0) -> DataFrame:
    """``key, id, allowed`` for a stream of ``key, id, ts``: a window opens at its first event and is over strictly after its end."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, n = state.get if state.exists else (-1, 0)
        pdf = _in_order(batches, ["t", "id"])
        ok = []
        for t in pdf.t.tolist():
            end, n = (t + int(seconds * 1e6), 1) if n == 0 or end < t else (end, n + 1)
            ok.append(n <= limit)
        yield pd.DataFrame({"key": pdf.key, "id": pdf.id, "allowed": ok})
        state.update((end, n))

    e = events.select(F.col("key").cast("string").alias("key"), "id", F.unix_micros("ts").alias("t"))
    return e.groupBy("key").applyInPandasWithState(run, "key string, id long, allowed boolean", "stop long, n long", "append", GroupStateTimeout.NoTimeout)


def job_states(ops: DataFrame) -> DataFrame:
    """``key, id, status, attempt, phase, error, outcome`` for a stream of ``key, id, op, attempt, phase, reason`` (``enqueue`` or a target status); late attempts change nothing."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempt, phase, error = state.get if state.exists else (None, 0, "", "")
        out = []
        for r in _in_order(batches, ["id"]).itertuples():
            if r.op == "enqueue":
                status, attempt, started = enqueue(status, attempt)
                if started:
                    phase, error = "", ""
                what = "started" if started else "running"
            elif status is None:
                out.append((r.key, r.id, "none", 0, "", "", "not_found"))
                continue
            else:
                status, phase, error, what = transition(status, attempt, int(r.attempt), r.op, phase, error, r.phase or "", r.reason or "")
            out.append((r.key, r.id, status, attempt, phase, error, what))
        yield pd.DataFrame(out, columns=["key", "id", "status", "attempt", "phase", "error", "outcome"])
        if status is not None:
            state.update((status, attempt, phase, error))

    o = ops.select(F.col("key").cast("string").alias("key"), "id", "op", F.col("attempt").cast("int").alias("attempt"), F.coalesce("phase", F.lit("")).alias("phase"), F.coalesce("reason", F.lit("")).alias("reason"))
    return o.groupBy("key").applyInPandasWithState(run, "key string, id long, status string, attempt int, phase string, error string, outcome string", "status string, attempt int, phase string, error string", "append", GroupStateTimeout.NoTimeout)


def visible_stream(deltas: DataFrame) -> DataFrame:
    """``answer_id, seq, shown`` for a stream of ``answer_id, seq, delta``: what may be shown after each piece of an answer."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = FooterFilter(*state.get) if state.exists else FooterFilter()
        pdf = _in_order(batches, ["seq"])
        yield pd.DataFrame({"answer_id": pdf.answer_id, "seq": pdf.seq, "shown": [f.write(x or "") for x in pdf.delta]})
        state.update((f.held, f.matched))

    return deltas.groupBy("answer_id").applyInPandasWithState(run, "answer_id long, seq long, shown string", "held string, matched boolean", "append", GroupStateTimeout.NoTimeout)


def usage(events: DataFrame) -> DataFrame:
    """Running counters and averages by type; the average of no value is 0."""
    n = F.count("value")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.when(n > 0, F.sum("value") / n).otherwise(0.0).alias("average"))


def idle_sessions(events: DataFrame, idle: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream that end after an idle gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle)).agg(F.count("*").alias("n"))


def canonical_counts(mentions: DataFrame) -> DataFrame:
    """Running mention counts of identities; a removal is a row with ``change`` -1. Identities at zero are gone to a reader that takes counts above it."""
    return mentions.groupBy("user_id", "kb_id", "normalized_text", "entity_type").agg(F.sum("change").alias("mention_count"))


def run_to_end(out: DataFrame, mode: str = "append") -> DataFrame:
    """Drive a streaming plan over what is there now, into files in the shared folder, and read them.

    Rows of ``append`` go through the file sink, whose log leaves out what a lost task wrote;
    the results of ``complete`` replace one another.
    """
    spark = out.sparkSession
    at = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    w = out.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        w = w.format("parquet").option("path", f"{at}/rows")
    else:
        w = w.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/rows"))
    w.start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")
