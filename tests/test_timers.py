import random

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import stateful as S
from graphloom.streaming import timers as T

BASE = 1_000_000_000  # event time begins at the epoch, and rows of that moment are late already
SCHEMA = "key string, id long, op string, s long"


def run(spark, path, files, fold, late="0 seconds"):
    """A stream whose files come one after the other, so that time passes between micro-batches."""
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{n:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/*")
    events = stream.select("key", "id", "op", F.timestamp_seconds(F.col("s") + BASE).alias("ts"))
    out = S.run_to_end(T.timed(events, fold, late))
    return sorted((r.key, r.at, r.event, r.id) for r in out.select("key", "id", "event", (F.unix_micros("at") / 1e6 - BASE).alias("at")).collect())


H = 3600


def test_a_session_is_warned_and_ends_while_others_go_on(spark, tmp_path):
    files = [[("a", 1, "", 0), ("b", 2, "", 0)], [("b", 3, "", 5 * H)], [("b", 4, "", 10 * H)], [("a", 5, "", 11 * H)], [("z", 6, "", 40 * H)]]
    got = [(k, int(at), e) for k, at, e, _ in run(spark, str(tmp_path), files, T.Sessions())]
    quarter = H // 4
    assert [x for x in got if x[0] == "a"] == [("a", 0, "opened"), ("a", 6 * H - quarter, "warned"), ("a", 6 * H, "expired"), ("a", 11 * H, "opened"), ("a", 17 * H - quarter, "warned"), ("a", 17 * H, "expired")]
    assert [x for x in got if x[0] == "b"] == [("b", 0, "opened"), ("b", 16 * H - quarter, "warned"), ("b", 16 * H, "expired")]
    assert [x for x in got if x[0] == "z"] == [("z", 40 * H, "opened")]


def test_the_hard_cap_ends_a_busy_session(spark, tmp_path):
    files = [[("a", i, "", i * H)] for i in range(27)]
    got = [(int(at) // H, e) for _, at, e, _ in run(spark, str(tmp_path), files, T.Sessions())]
    assert got == [(0, "opened"), (23, "warned"), (24, "expired"), (24, "opened")]


def test_a_pending_scan_fails_and_a_late_result_changes_nothing(spark, tmp_path):
    files = [[("a", 1, "pending", 0), ("b", 2, "pending", 0)], [("b", 3, "NO_THREATS_FOUND", H)], [("z", 4, "pending", 3 * H)], [("a", 5, "NO_THREATS_FOUND", 4 * H)], [("z", 6, "pending", 4 * H)]]
    got = [(k, int(at) // H, e) for k, at, e, _ in run(spark, str(tmp_path), files, T.Scans())]
    assert got == [("a", 0, "pending"), ("a", 2, "failed"), ("b", 0, "pending"), ("b", 1, "NO_THREATS_FOUND"), ("z", 3, "pending")]


def test_counters_go_when_they_are_stale(spark, tmp_path):
    files = [[("a", 1, "", 0), ("a", 2, "", 10)], [("b", 3, "", 200)], [("b", 4, "", 5000)]]
    got = [(k, int(at), e) for k, at, e, _ in run(spark, str(tmp_path), files, T.Limits(1, 60, 100))]
    assert got == [("a", 0, "allowed"), ("a", 10, "refused"), ("a", 160, "expired"), ("b", 200, "allowed"), ("b", 360, "expired"), ("b", 5000, "allowed")]


@pytest.mark.parametrize("fold", [T.Limits(2, 60, 30), T.Sessions(0.1, 0.03, 0.01), T.Scans(0.02)])
def test_batches_don_t_matter(fold):
    """However the rows are cut into runs, with time passing in between or not, the events are the same."""
    rng = random.Random(3)
    t, rows = 0, []
    for i in range(200):
        t += rng.choice([0, 5, 20, 90, 400]) * 1_000_000
        rows.append((i, rng.choice(["pending", "ok"]), t))
    whole = T.play(fold, None, rows, t)
    for _ in range(20):
        cuts = sorted(rng.sample(range(201), 5))
        s, out = None, []
        for a, b in zip([0, *cuts], [*cuts, 200], strict=True):
            s, more = T.play(fold, s, rows[a:b], rows[b - 1][2] if b and rng.random() < 0.5 else None)
            out += more
        s, more = T.play(fold, s, [], t)
        assert (s, out + more) == whole


def test_rows_without_key_or_time_and_empty_streams(spark, tmp_path):
    assert run(spark, str(tmp_path / "a"), [[(None, 1, "", 0), ("a", 2, "", None)]], T.Sessions()) == []
    assert run(spark, str(tmp_path / "b"), [[]], T.Scans()) == []
