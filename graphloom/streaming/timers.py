"""Streams in which time itself is an event: counters that expire, sessions that end, scans that time out.

Each is a pure fold: ``take`` handles a row, ``deadline`` says when something happens by
itself, and ``fire`` does that. The stateful operator keeps one state a key, plays the rows
of a micro-batch in order of time, fires what falls due between them, and leaves one timer
for the rest. So the result doesn't depend on how rows fall into micro-batches, and a key
without anything due has no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR, MINUTE = 3_600_000_000, 60_000_000
State = tuple[int, int, int] | None
#: ``(id, event, time)`` in microseconds; the id is null for what happens by itself.
Out = list[tuple[int | None, str, int]]
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Limits:
    """A fixed-window limiter whose counters go once their window is over for longer than ``stale``."""

    def __init__(self, limit: int = 100, seconds: float = 60.0, stale: float = 3600.0):
        self.limit, self.window, self.stale = limit, int(seconds * 1e6), int(stale * 1e6)

    def take(self, s: State, i: int, op: str, t: int) -> tuple[State, Out]:
        end, n = (t + self.window, 1) if s is None or s[0] < t else (s[0], s[1] + 1)
        return (end, n, 0), [(i, "allowed" if n <= self.limit else "refused", t)]

    def deadline(self, s: State) -> int | None:
        return None if s is None else s[0] + self.stale + 1  # strictly after

    def fire(self, s: State) -> tuple[State, Out]:
        return None, [(None, "expired", self.deadline(s))]


class Sessions:
    """A session ends ``idle`` after its last activity or ``cap`` after its first, whichever comes first; once, ``lead`` before, it is warned."""

    def __init__(self, cap: float = 24, idle: float = 6, lead: float = 0.25):
        self.cap, self.idle, self.lead = int(cap * HOUR), int(idle * HOUR), int(lead * HOUR)

    def take(self, s: State, i: int, op: str, t: int) -> tuple[State, Out]:
        return ((t, t, 0), [(i, "opened", t)]) if s is None else ((s[0], t, s[2]), [])

    def deadline(self, s: State) -> int | None:
        if s is None:
            return None
        end = min(s[0] + self.cap, s[1] + self.idle)
        return end if s[2] else end - self.lead

    def fire(self, s: State) -> tuple[State, Out]:
        at = self.deadline(s)
        return (None, [(None, "expired", at)]) if s[2] else ((s[0], s[1], 1), [(None, "warned", at)])


class Scans:
    """A scan that is ``pending`` fails once ``wait`` hours have passed without a result; results of no pending scan change nothing."""

    def __init__(self, wait: float = 2):
        self.wait = int(wait * HOUR)

    def take(self, s: State, i: int, op: str, t: int) -> tuple[State, Out]:
        if op == "pending":
            return ((t, 0, 0), [(i, "pending", t)]) if s is None else (s, [])
        return (None, [(i, op, t)]) if s is not None else (None, [])

    def deadline(self, s: State) -> int | None:
        return None if s is None else s[0] + self.wait

    def fire(self, s: State) -> tuple[State, Out]:
        return None, [(None, "failed", self.deadline(s))]


def play(fold, s: State, rows: list[tuple[int, str, int]], until: int | None = None) -> tuple[State, Out]:
    """The fold over ``(id, op, time)`` in order, and then up to ``until``."""
    out: Out = []

    def pass_to(now: int) -> None:
        nonlocal s
        while (due := fold.deadline(s)) is not None and due <= now:
            s, more = fold.fire(s)
            out.extend(more)

    for i, op, t in rows:
        pass_to(t)
        s, more = fold.take(s, i, op, t)
        out.extend(more)
    if until is not None:
        pass_to(until)
    return s, out


class _Timed(StatefulProcessor):
    def __init__(self, fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "a long, b long, c long")

    def _keep(self, key: tuple, s: State, out: Out) -> Iterator[pd.DataFrame]:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if s is None:
            self.state.clear()
        else:
            self.state.update(s)
            self.handle.registerTimer(-(-self.fold.deadline(s) // 1000))  # milliseconds, not before it is due
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "id": pd.array([o[0] for o in out], "Int64"), "event": [o[1] for o in out], "at": pd.to_datetime([o[2] for o in out], unit="us")})

    def _now(self) -> State:
        return tuple(self.state.get()) if self.state.exists() else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["t", "id"], kind="stable")
        yield from self._keep(key, *play(self.fold, self._now(), list(zip(pdf.id.tolist(), pdf.op.tolist(), pdf.t.tolist(), strict=True))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # What falls due behind this timer may be over as well.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        yield from self._keep(key, *play(self.fold, self._now(), [], now * 1000))

    def close(self) -> None:
        pass


def timed(events: DataFrame, fold, late: str = "0 seconds") -> DataFrame:
    """``key, id, event, at`` for a stream of ``key, id, op, ts``: what ``fold`` gives for each row, and what happens by itself as event time passes.

    Event time is the latest ``ts`` less ``late``; rows behind it are left out. Rows without key or time are left out too.
    The rows that one micro-batch has of a key are held together, which the source's limit on a micro-batch bounds.
    """
    conf = events.sparkSession.conf
    if conf.get(PROVIDER[0], "") != PROVIDER[1]:
        conf.set(*PROVIDER)  # the only store that has timers
    e = events.where("key is not null and ts is not null").withWatermark("ts", late).select(F.col("key").cast("string").alias("key"), "id", F.col("op").cast("string").alias("op"), F.unix_micros("ts").alias("t"), "ts")
    return e.groupBy("key").transformWithStateInPandas(_Timed(fold), "key string, id long, event string, at timestamp", "Append", "EventTime")
