import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import normalized
from graphloom.operators import extraction as X
from graphloom.operators.blocks import numbered, themes
from graphloom.operators.lifecycle import allowed_window, error_class, publish, retry_guard
from graphloom.sources import sinks
from graphloom.sources.tables import ground_truth, text_files
from graphloom.streaming import stateful as S

MANY = 25_000  # more than one Arrow batch of a key


def _stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_limiter_keeps_order_across_batches(spark, tmp_path):
    rows = [("a", i, i) for i in range(MANY)]
    random.Random(1).shuffle(rows)
    stream = _stream(spark, rows, "key string, id long, s long", str(tmp_path / "in"))
    stream = stream.select("key", "id", F.timestamp_seconds("s").alias("ts"))
    got = {r.id for r in S.run_to_end(S.rate_limited(stream, 1, 60)).where("allowed").collect()}
    assert got == set(range(0, MANY, 61))
    batch = spark.createDataFrame(rows, "key string, id long, s long").select("key", "id", F.timestamp_seconds("s").alias("ts"))
    assert {r.id for r in allowed_window(batch, 1, 60).where("allowed").collect()} == got


def test_jobs_keep_order_across_batches(spark, tmp_path):
    ops = ["enqueue", "processing", "failed", "processing", "succeeded"]
    rows = [("k", i, ops[i % 5], i // 5 + 1, f"p{i % 3}", f"r{i}") for i in range(MANY)]
    random.Random(2).shuffle(rows)
    out = S.run_to_end(S.job_states(_stream(spark, rows, "key string, id long, op string, attempt int, phase string, reason string", str(tmp_path / "in"))))
    got = {r.id: r for r in out.collect()}
    status, attempt, phase, error = None, 0, "", ""
    for _, i, op, of, new, why in sorted(rows, key=lambda r: r[1]):
        if op == "enqueue":
            status, attempt, started = S.enqueue(status, attempt)
            what, phase, error = ("started", "", "") if started else ("running", phase, error)
        else:
            status, phase, error, what = S.transition(status, attempt, of, op, phase, error, new, why)
        assert tuple(got[i]) == ("k", i, status, attempt, phase, error, what)


def test_counts_fall_to_zero(spark, tmp_path):
    schema = "user_id string, kb_id string, normalized_text string, entity_type string, change int"
    rows = [("u", "k", "a", "t", 1)] * 3 + [("u", "k", "a", "t", -1)] + [("u", "k", "b", "t", 1), ("u", "k", "b", "t", -1)]
    out = S.run_to_end(S.canonical_counts(_stream(spark, rows, schema, str(tmp_path / "in"))), "complete").where("mention_count > 0")
    assert [(r.normalized_text, r.mention_count) for r in out.collect()] == [("a", 2)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "k", "x"), (2, "v", "k", None)], "document_id long, user_id string, kb_id string, text string")
    columns, at = ["document_id", "user_id", "kb_id", "text"], str(tmp_path / "t")
    sinks.insert_rows(rows, at, columns)
    sinks.insert_rows(rows, at, columns)  # an insert adds, it doesn't replace
    assert sorted(map(tuple, sinks.saved(spark, at, rows, columns).collect())) == sorted(map(tuple, rows.union(rows).collect()))
    sinks.insert_rows(rows.limit(0), at, columns)
    with pytest.raises(ValueError):
        sinks.insert_rows(rows, at, [*columns, "missing"])
    with pytest.raises(Exception, match="row without kb_id"):
        sinks.insert_rows(rows.withColumn("kb_id", F.lit(None).cast("string")), at, columns)
    boxes = rows.select("document_id", "user_id", "kb_id", F.lit("figure").alias("region_type"), F.lit(1).alias("page_number"), F.struct(F.lit(0.5).alias("y0")).alias("bounding_box"), F.lit("skipped").alias("status"), F.lit("v").alias("extractor_version"))
    sinks.save_regions(boxes, str(tmp_path / "r"))
    assert {r.bounding_box for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {'{"y0":0.5}'}


def test_staging_keeps_attempts_apart(spark, tmp_path):
    at = str(tmp_path / "s")
    one = spark.createDataFrame([(1, 1, "old"), (2, 1, None)], "document_id long, attempt int, text string")
    sinks.stage(one, at)
    sinks.stage(spark.createDataFrame([(1, 2, "new")], one.schema), at)
    current = spark.createDataFrame([(1, 2), (2, 1)], "document_id long, attempt int")
    got = sinks.staged(spark, at, "text string", current)
    assert sorted((r.document_id, r.attempt, r.text) for r in got.collect()) == [(1, 2, "new"), (2, 1, None)]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "a b").mkdir(parents=True)
    (tmp_path / "in" / "a b" / "x+1.TXT").write_text("one\ntwo")
    got = [tuple(r) for r in text_files(spark, str(tmp_path / "in")).collect()]
    assert got == [("a b/x+1.TXT", "text/plain", "one\ntwo")]
    (tmp_path / "in" / "y.exe").write_text("no")
    with pytest.raises(Exception, match="extension not accepted: y.exe"):
        text_files(spark, str(tmp_path / "in")).collect()
    truth = tmp_path / "truth.json"
    truth.write_text('{"pairs": [{"id": 1,\n "documents": ["a", "b"]}, {"id": 2, "documents": []}], "questions": []}')
    assert [(r.id, r.documents) for r in ground_truth(spark, str(truth), "pairs").collect()] == [(1, ["a", "b"]), (2, [])]


def test_batches(spark):
    chunks = spark.createDataFrame([(d * 10 + i, d, i) for d in (1, 2) for i in range(5)], "chunk_id long, document_id long, ordinal int")
    b = X.plan_batches(chunks, 2)
    assert {r.chunk_id: r.batch for r in b.collect()} == {d * 10 + i: i // 2 for d in (1, 2) for i in range(5)}
    results = b.select("document_id", F.lit(1).alias("attempt"), "batch", "chunk_id")
    foreign = results.withColumn("chunk_id", F.col("chunk_id") + 2)
    current = spark.createDataFrame([(1, 1), (2, 2)], "document_id long, attempt int")
    done = spark.createDataFrame([(12,)], "chunk_id long")
    assert sorted(r.chunk_id for r in X.kept_results(b, results.union(foreign), done, current).collect()) == [10, 11, 14]
    vectors = spark.createDataFrame([(1, i, [float(i)]) for i in range(5)] + [(2, 0, [9.0])], "document_id long, ordinal int, embedding array<double>")
    assert {r.chunk_id: r.embedding for r in X.backfill(chunks, vectors).collect()} == {10 + i: [float(i)] for i in range(5)}
    assert {r.document_id: r.status for r in X.vector_status(chunks, vectors).collect()} == {1: "ok", 2: "mismatch"}


def test_publication_and_guards(spark):
    key = "user_id string, document_id long, job_type string"
    jobs = spark.createDataFrame([("u", 1, "a", "processing", 2, ""), ("u", 2, "a", "failed", 1, "x")], f"{key}, status string, attempt int, error string")
    asked = spark.createDataFrame([("u", d, "a") for d in (1, 1, 2, 3)], key)
    lost = spark.createDataFrame([("u", 1, "a", "down"), ("u", 3, "a", "down")], f"{key}, reason string")
    got = {r.document_id: (r.attempt, r.status, r.started, r.error) for r in publish(jobs, asked, lost).collect()}
    assert got == {1: (2, "processing", False, ""), 2: (2, "pending", True, ""), 3: (1, "failed", True, "down")}
    docs = spark.createDataFrame([(1, "failed"), (2, "failed"), (3, "failed"), (4, None)], "document_id long, status string")
    got = {r.document_id: r.verdict for r in retry_guard(docs, jobs, docs.where("document_id = 3")).collect()}
    assert got == {1: "busy", 2: "retry", 3: "rejected", 4: "not_failed"}
    states = spark.createDataFrame([("22P02",), ("23",), ("08006",), ("2",), ("",), (None,)], "s string")
    assert [r[0] for r in states.select(error_class(F.col("s"))).collect()] == ["deterministic"] * 2 + ["transient"] * 4


def test_numbered_replies(spark):
    text = "INTRUDER: none yet\nSET: 1\nintruder: no\nINTRUDER: a\n SET: -2\r\nINTRUDER: b: c\nSET: x\nINTRUDER: lost\nSET: 1\nINTRUDER: last"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(numbered(F.col("t"), ["SET"], "INTRUDER").alias("x"))
    assert [[(list(y.ids), y.value) for y in r.x] for r in df.collect()] == [[([-2], "b: c"), ([1], "last")], [], []]


def test_themes(spark):
    sizes = F.create_map(*(F.lit(x) for i in range(1, 6) for x in (i, 10 * i)))
    texts = ["NONE", "COMMUNITY: 7\nLABEL: x\nNOTE: y", "".join(f"COMMUNITY: {i}\nLABEL: l{i}\n" for i in range(1, 6)) + "NOTE: n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(themes(F.col("t"), sizes).alias("x"))
    got = [([(t.id, t.label, t.summary, t.size) for t in r.x.themes], r.x.note) for r in df.collect()]
    assert got == [([], ""), ([], ""), ([(i, f"l{i}", "", 10 * i) for i in (1, 2, 3)], "n"), ([], "")]


def test_names_are_normalised_by_compatibility(spark):
    df = spark.createDataFrame([("Ａcme  ﬁrm",), ("ACME firm",), (None,), ("Ünal x",)], "t string")
    assert [r[0] for r in df.select(normalized(F.col("t"))).collect()] == ["acme firm", "acme firm", None, "ünal x"]


def test_ground_truth_files_are_written_by_tasks_of_64_files_or_so(spark, tmp_path):
    """One task wrote all of them before, and one read them all for their fields."""
    from graphloom.plans.pipeline_queries import _ground_truth

    spark.range(20_000).selectExpr("id as doc_id", "concat('s', id % 3) as source", "'en' as lang", "'' as text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    pairs, docs = _ground_truth(spark, str(tmp_path))
    files = [f.rsplit("/", 1)[-1] for f in pairs.inputFiles()]
    assert len(files) == 201 and len({f[:10] for f in files}) > 1
    assert pairs.count() == 20_000 - 3 and docs.count() == 20_000
    assert sorted(pairs.where("a = 's1/en/4.txt'").collect()) == [("s1/en/4.txt", "s1/en/7.txt")]
