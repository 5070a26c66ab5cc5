"""Streaming queries, each driven over its table to the end, with the SQL of their batch meaning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.lineage import shared_folder
from ..sources.versions import COUNTS, Versions, merge_counts
from ..streaming import stateful as S
from ..streaming import timers as T
from .lifecycle_queries import LIMITER

QUERIES: dict = {}
ORACLES: dict = {}


def _stream(spark, d, name):
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


def t01(spark, d):
    e = _stream(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return S.run_to_end(S.rate_limited(e, 1, 3600)).select(F.col("key").cast("long").alias("key"), "id", "allowed")


# Operations on fifty jobs in order of event: attempts 1 to 3 report, some of them late.
OPS = "SELECT (user_id % 50)::VARCHAR AS key, event_id AS id, ['enqueue', 'processing', 'succeeded', 'failed'][event_id % 4 + 1] AS op, event_id % 3 + 1 AS of, CASE WHEN event_id % 5 = 0 THEN 'embedding' ELSE '' END AS np, 'r' || event_id % 7 AS reason, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS r FROM events"
JOBS = f"""WITH RECURSIVE o AS ({OPS}),
f(key, id, r, status, attempt, phase, error, outcome) AS (
  SELECT DISTINCT key, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, 0, '', '', '' FROM o
  UNION ALL
  SELECT key, id, r, CASE outcome WHEN 'started' THEN 'pending' WHEN 'changed' THEN op ELSE status END, CASE WHEN outcome = 'started' THEN attempt + 1 ELSE attempt END,
    CASE WHEN outcome = 'started' OR (outcome = 'changed' AND op = 'succeeded') THEN '' WHEN outcome = 'changed' AND op = 'processing' AND np <> '' THEN np ELSE phase END,
    CASE WHEN outcome = 'started' OR (outcome = 'changed' AND op = 'succeeded') THEN '' WHEN outcome = 'changed' AND op = 'failed' THEN reason ELSE error END, outcome
  FROM (SELECT o.*, f.status, f.attempt, f.phase, f.error, CASE
      WHEN o.op = 'enqueue' THEN CASE WHEN f.status IN ('pending', 'processing') THEN 'running' ELSE 'started' END
      WHEN f.status IS NULL THEN 'not_found' WHEN o.of <> f.attempt THEN 'superseded'
      WHEN f.status NOT IN ('pending', 'processing') THEN CASE WHEN f.status = o.op THEN 'same' ELSE 'not_active' END
      WHEN o.op = 'processing' AND f.status = 'processing' AND o.np IN ('', f.phase) THEN 'same' ELSE 'changed' END AS outcome
    FROM f JOIN o ON o.key = f.key AND o.r = f.r + 1) AS q)
SELECT key, id, coalesce(status, 'none') AS status, attempt, phase, error, outcome FROM f WHERE r > 0"""


def t03(spark, d):
    ops = F.element_at(F.array(*map(F.lit, ["enqueue", "processing", "succeeded", "failed"])), (F.col("event_id") % 4 + 1).cast("int"))
    phase = F.when(F.col("event_id") % 5 == 0, "embedding").otherwise("")
    e = _stream(spark, d, "events").select((F.col("user_id") % 50).alias("key"), F.col("event_id").alias("id"), ops.alias("op"), (F.col("event_id") % 3 + 1).alias("attempt"), phase.alias("phase"), F.concat(F.lit("r"), F.col("event_id") % 7).alias("reason"))
    return S.run_to_end(S.job_states(e))


def t07(spark, d):
    change = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    e = _stream(spark, d, "events").select(F.col("event_type").alias("user_id"), F.lit("kb").alias("kb_id"), F.col("user_id").cast("string").alias("normalized_text"), F.lit("person").alias("entity_type"), change.alias("change"))
    at = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    e.writeStream.foreachBatch(merge_counts(f"{at}/table")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return Versions(spark, f"{at}/table", {"counts": COUNTS}).read_all("counts").where("mention_count > 0")


def t10(spark, d):
    c = _stream(spark, d, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("seq"), F.when(F.col("turn") == 2, "Cita").when(F.col("turn") == 3, "tions: 1 ").otherwise(F.concat("text", F.lit(" "))).alias("delta"))
    return S.run_to_end(S.visible_stream(c)).groupBy("answer_id").agg(F.sum(F.length("shown")).alias("shown"))


def t11(spark, d):
    return S.run_to_end(S.usage(_stream(spark, d, "events")), "complete").select("event_type", "n", F.round("average", 4).alias("average"))


QUERIES["T01_rate_limiter_stream"], ORACLES["T01_rate_limiter_stream"] = t01, LIMITER
QUERIES["T03_job_states_stream"], ORACLES["T03_job_states_stream"] = t03, JOBS
QUERIES["T04_superseded_attempts"] = lambda spark, d: t03(spark, d).where("outcome = 'superseded'").select("key", "id", "status", "attempt")
ORACLES["T04_superseded_attempts"] = f"SELECT key, id, status, attempt FROM ({JOBS}) AS z WHERE outcome = 'superseded'"
QUERIES["T07_canonical_counts_stream"] = t07
ORACLES["T07_canonical_counts_stream"] = "SELECT event_type AS user_id, 'kb' AS kb_id, user_id::VARCHAR AS normalized_text, 'person' AS entity_type, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS mention_count FROM events GROUP BY event_type, user_id HAVING sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) > 0"
# The footer comes in two pieces, of which the first alone is held back at the end of a stream.
QUERIES["T10_footer_filter_stream"], ORACLES["T10_footer_filter_stream"] = t10, """SELECT answer_id, CASE WHEN contains(lower(s), 'citations:') THEN instr(lower(s), 'citations:') - 1 WHEN s LIKE '%Cita' THEN length(s) - 4 ELSE length(s) END AS shown
FROM (SELECT conv_id AS answer_id, string_agg(CASE turn WHEN 2 THEN 'Cita' WHEN 3 THEN 'tions: 1 ' ELSE text || ' ' END, '' ORDER BY turn) AS s FROM conversations GROUP BY conv_id) AS q"""
QUERIES["T11_usage_stream"], ORACLES["T11_usage_stream"] = t11, "SELECT event_type, count(*) AS n, round(sum(value) / count(value), 4) AS average FROM events GROUP BY event_type"


# Timers: what falls due before the last event's time happens, the rest is still open.
def _timed(spark, d, fold, op):
    e = _stream(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), op.alias("op"), F.col("ts").cast("timestamp").alias("ts"))
    return S.run_to_end(T.timed(e, fold)).select(F.col("key").cast("long").alias("key"), "id", "event", F.unix_micros("at").alias("at_us"))


_ROWS = "WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), top AS (SELECT max(epoch_us(ts)) AS now FROM events)"
COUNTERS = _ROWS + """,
f(key, id, r, stop, n, t, gone) AS (SELECT key, id, r, t + 3600000000, 1, t, NULL::BIGINT FROM e WHERE r = 1 UNION ALL
  SELECT e.key, e.id, e.r, CASE WHEN f.stop < e.t THEN e.t + 3600000000 ELSE f.stop END, CASE WHEN f.stop < e.t THEN 1 ELSE f.n + 1 END, e.t, CASE WHEN f.stop + 1800000001 <= e.t THEN f.stop + 1800000001 END FROM f JOIN e ON e.key = f.key AND e.r = f.r + 1),
last AS (SELECT key, stop + 1800000001 AS gone FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY r DESC) = 1)
SELECT key, NULL::BIGINT AS id, 'expired' AS event, gone AS at_us FROM (SELECT key, gone FROM f WHERE gone IS NOT NULL UNION ALL SELECT key, gone FROM last, top WHERE gone < now) AS q"""
SWEEP = _ROWS + """,
f(key, id, r, t, created, seen, warned, out_warn, out_end, opened) AS (SELECT key, id, r, t, t, t, false, NULL::BIGINT, NULL::BIGINT, true FROM e WHERE r = 1 UNION ALL
  SELECT e.key, e.id, e.r, e.t, CASE WHEN e.t >= x.stop THEN e.t ELSE x.created END, e.t, CASE WHEN e.t >= x.stop THEN false ELSE x.warned OR e.t >= x.stop - 900000000 END,
    CASE WHEN NOT x.warned AND e.t >= x.stop - 900000000 THEN x.stop - 900000000 END, CASE WHEN e.t >= x.stop THEN x.stop END, e.t >= x.stop
  FROM (SELECT *, least(created + 86400000000, seen + 21600000000) AS stop FROM f) AS x JOIN e ON e.key = x.key AND e.r = x.r + 1),
last AS (SELECT key, warned, least(created + 86400000000, seen + 21600000000) AS stop FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY r DESC) = 1)
SELECT key, id, 'opened' AS event, t AS at_us FROM f WHERE opened UNION ALL SELECT key, NULL, 'warned', out_warn FROM f WHERE out_warn IS NOT NULL UNION ALL SELECT key, NULL, 'expired', out_end FROM f WHERE out_end IS NOT NULL
UNION ALL SELECT key, NULL, 'warned', stop - 900000000 FROM last, top WHERE NOT warned AND stop - 900000000 < now UNION ALL SELECT key, NULL, 'expired', stop FROM last, top WHERE stop < now"""
SCANS = _ROWS + """,
o AS (SELECT *, CASE id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'NO_THREATS_FOUND' ELSE 'THREATS_FOUND' END AS op FROM e),
f(key, id, r, t, since, out_op, out_fail) AS (SELECT key, id, r, t, CASE WHEN op = 'pending' THEN t END, CASE WHEN op = 'pending' THEN op END, NULL::BIGINT FROM o WHERE r = 1 UNION ALL
  SELECT o.key, o.id, o.r, o.t, CASE WHEN o.op <> 'pending' THEN NULL WHEN x.live IS NULL THEN o.t ELSE x.live END, CASE WHEN (o.op = 'pending') = (x.live IS NULL) THEN o.op END, CASE WHEN x.since IS NOT NULL AND x.live IS NULL THEN x.since + 7200000000 END
  FROM (SELECT f.*, CASE WHEN f.since + 7200000000 > n.t THEN f.since END AS live FROM f JOIN o n ON n.key = f.key AND n.r = f.r + 1) AS x JOIN o ON o.key = x.key AND o.r = x.r + 1),
last AS (SELECT key, since + 7200000000 AS stop FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY r DESC) = 1)
SELECT key, id, out_op AS event, t AS at_us FROM f WHERE out_op IS NOT NULL UNION ALL SELECT key, NULL, 'failed', out_fail FROM f WHERE out_fail IS NOT NULL UNION ALL SELECT key, NULL, 'failed', stop FROM last, top WHERE stop < now"""
QUERIES["T02_counters_expire"] = lambda spark, d: _timed(spark, d, T.Limits(1, 3600, 1800), F.lit("")).where("event = 'expired'")
ORACLES["T02_counters_expire"] = COUNTERS
QUERIES["T06_sessions_end"] = lambda spark, d: _timed(spark, d, T.Sessions(), F.lit(""))
ORACLES["T06_sessions_end"] = SWEEP
QUERIES["T09_scans_time_out"] = lambda spark, d: _timed(spark, d, T.Scans(), F.element_at(F.array(*map(F.lit, ["pending", "NO_THREATS_FOUND", "THREATS_FOUND"])), (F.col("event_id") % 3 + 1).cast("int")))
ORACLES["T09_scans_time_out"] = SCANS
