"""Queries over sinks, batch jobs, publication and parsed replies, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import extraction as X
from ..operators import lifecycle as L
from ..operators.model import KB, mentions, windows
from ..sources import sinks as S
from ..sources.lineage import cut, shared_folder
from ..sources.tables import documents, table
from .lifecycle_queries import JOB, _jobs
from .prelude import sql

QUERIES: dict = {}
ORACLES: dict = {}
SIZES = (600, 60)


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def _place(spark) -> str:
    return f"{shared_folder(spark)}/sinks/{uuid.uuid4().hex}"


def _chunks(spark, d):
    return windows(documents(spark, d), *SIZES)


@query("S07_inserted_rows", "SELECT source AS user_id, lang AS kb_id, doc_id AS document_id, octet_length(encode(text)) AS bytes FROM documents")
def _(spark, d):
    rows, at = documents(spark, d).withColumn("bytes", F.octet_length("text").cast("long")), _place(spark)
    columns = ["user_id", "kb_id", "document_id", "bytes"]
    S.insert_rows(rows, at, columns)
    return S.saved(spark, at, rows, columns)


@query("S08_chunk_sink", sql("SELECT chunk_id, document_id, user_id, kb_id, ordinal, text, token_count, char_start, char_end FROM chunks", "chunks"))
def _(spark, d):
    rows, at = _chunks(spark, d), _place(spark)
    S.save_chunks(rows, at)
    return S.saved(spark, at, rows, S.CHUNK_COLUMNS)


@query("S09_entity_sink", sql("SELECT mention_id, chunk_id, document_id, user_id, kb_id, entity_type, text, char_start, char_end, round(score, 6) AS score FROM mentions", "mentions"))
def _(spark, d):
    rows, at = mentions(_chunks(spark, d)), _place(spark)
    S.save_entities(rows, at)
    return S.saved(spark, at, rows, S.ENTITY_COLUMNS).withColumn("score", F.round("score", 6))


@query("S11_manifest_sink", "SELECT page_id AS document_id, 'u' || page_id % 3 AS user_id, 'kb' AS kb_id, 'figure' AS region_type, page_id % 5 AS page_number, page_id % 7 AS y0, 'skipped' AS status, 'v1' AS extractor_version FROM pages")
def _(spark, d):
    p = F.col("page_id")
    rows = table(spark, d, "pages").select(
        p.alias("document_id"), F.concat(F.lit("u"), p % 3).alias("user_id"), F.lit("kb").alias("kb_id"), F.lit("figure").alias("region_type"), (p % 5).alias("page_number"),
        F.struct((p % 7).alias("y0")).alias("bounding_box"), F.lit("skipped").alias("status"), F.lit("v1").alias("extractor_version"))
    at = _place(spark)
    S.save_regions(rows, at)
    back = S.saved(spark, at, rows.withColumn("bounding_box", F.to_json("bounding_box")), S.REGION_COLUMNS)
    return back.withColumn("y0", F.get_json_object("bounding_box", "$.y0").cast("long")).drop("bounding_box")


@query("S20_staged_batches", "SELECT conv_id AS document_id, turn, role, text FROM conversations")
def _(spark, d):
    """Two attempts a conversation; only the second's input is read."""
    c = table(spark, d, "conversations").select((F.col("conv_id") % 16).alias("document_id"), "conv_id", "turn", "role", "text")
    at = _place(spark)
    S.stage(c.withColumn("attempt", F.lit(1)).withColumn("text", F.lit("stale")).unionByName(c.withColumn("attempt", F.lit(2))), at)
    current = c.select("document_id", F.lit(2).alias("attempt")).distinct()
    back = S.staged(spark, at, "conv_id long, turn long, role string, text string", current)
    kind = c.schema
    return back.select(F.col("conv_id").cast(kind["conv_id"].dataType).alias("document_id"), F.col("turn").cast(kind["turn"].dataType).alias("turn"), "role", "text")


@query("S21_vector_counts", "SELECT doc_id AS document_id, 1::BIGINT AS chunks, (vec_id IS NOT NULL)::BIGINT AS vectors, CASE WHEN vec_id IS NULL THEN 'mismatch' ELSE 'ok' END AS status FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def _(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("ordinal"), "embedding")
    return X.vector_status(c, v.join(c.select("document_id"), "document_id", "left_semi"))


@query("S21_zip_by_ordinal", "SELECT doc_id AS document_id, round(embedding[1]::DOUBLE, 6) AS x FROM documents JOIN embeddings ON vec_id = doc_id")
def _(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ordinal"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("ordinal"), "embedding")
    return X.backfill(c, v).select("document_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


# Batches of four; each chunk has a result, and one for the chunk four places on, which is another batch's.
# Odd documents stand at attempt 2, so that their results of attempt 1 are late; the first chunk of every seventh document was saved before.
@query("G04_batch_results", sql("SELECT document_id, batch, chunk_id FROM (SELECT document_id, ordinal // 4 AS batch, chunk_id FROM chunks) AS q WHERE document_id % 2 = 0 AND NOT (document_id % 7 = 0 AND batch = 0)", "chunks"))
def _(spark, d):
    b = cut(X.plan_batches(_chunks(spark, d).select("chunk_id", "document_id", "ordinal"), 4))
    own = b.select("document_id", F.lit(1).alias("attempt"), "batch", "chunk_id")
    foreign = own.withColumn("chunk_id", F.col("chunk_id") + 4)
    current = b.select("document_id").distinct().select("document_id", (F.col("document_id") % 2 + 1).cast("int").alias("attempt"))
    done = b.where("document_id % 7 = 0 and ordinal = 0")
    return X.kept_results(b, own.unionByName(foreign), done, current).select("document_id", F.col("batch").cast("long").alias("batch"), "chunk_id")


# A document's status is that of its newest job; a user is a document here, and every third one was rejected by the scan.
DOCS = f"SELECT document_id, CASE arg_max(status, event_id) WHEN 'succeeded' THEN 'indexed' ELSE arg_max(status, event_id) END AS status, bool_or(status IN ('pending', 'processing') AND event_id % 10 = 0) AS busy FROM ({JOB}) AS q GROUP BY document_id"


def _states(spark, d):
    j = _jobs(spark, d)
    s = F.max_by("status", "event_id")
    docs = j.groupBy("document_id").agg(F.when(s == "succeeded", "indexed").otherwise(s).alias("status"))
    return docs, j.where("event_id % 10 = 0")


@query("L05_retry_guard", f"SELECT document_id, CASE WHEN status <> 'failed' THEN 'not_failed' WHEN busy THEN 'busy' WHEN document_id % 3 = 0 THEN 'rejected' ELSE 'retry' END AS verdict FROM ({DOCS}) AS z")
def _(spark, d):
    docs, jobs = _states(spark, d)
    return L.retry_guard(docs, jobs, docs.where("document_id % 3 = 0"))


@query("L06_reextract_guard", f"SELECT document_id, CASE WHEN status <> 'indexed' THEN 'not_indexed' WHEN busy THEN 'busy' ELSE 'reextract' END AS verdict FROM ({DOCS}) AS z")
def _(spark, d):
    return L.reextract_guard(*_states(spark, d))


STATUS = "SELECT doc_id AS document_id, source AS user_id, CASE WHEN doc_id % 2 = 0 THEN 'indexed' ELSE 'pending' END AS status FROM documents"


def _updated(spark, d):
    docs = documents(spark, d).select("document_id", "user_id", F.lit("pending").alias("status"))
    even = docs.where("document_id % 2 = 0")
    # An update in another tenant's name finds nothing.
    foreign = even.withColumn("user_id", F.lit("nobody"))
    return L.update_status(docs, even.unionByName(foreign).withColumn("new_status", F.lit("indexed")))


QUERIES["L03_status_update"], ORACLES["L03_status_update"] = lambda spark, d: _updated(spark, d)[0], STATUS
QUERIES["L03_status_not_found"] = lambda spark, d: _updated(spark, d)[1].select("document_id", "user_id")
ORACLES["L03_status_not_found"] = "SELECT doc_id AS document_id, 'nobody' AS user_id FROM documents WHERE doc_id % 2 = 0"


@query("L09_publish", f"""WITH j AS (SELECT 'u' AS user_id, document_id, job_type, arg_max(status, event_id) AS was, count(*)::INTEGER AS last FROM ({JOB}) AS q GROUP BY ALL),
r AS (SELECT 'u' AS user_id, document_id, job_type FROM (SELECT DISTINCT user_id AS document_id FROM events) AS e, (SELECT unnest(['document_indexing', 'malware_scan', 'ocr']) AS job_type) AS t)
SELECT user_id, document_id, job_type, CASE WHEN started THEN coalesce(last, 0) + 1 ELSE last END AS attempt, CASE WHEN started AND document_id % 5 = 0 THEN 'failed' WHEN started THEN 'pending' ELSE was END AS status, started, CASE WHEN started AND document_id % 5 = 0 THEN 'no target' ELSE '' END AS error
FROM (SELECT r.*, was, last, was IS NULL OR was NOT IN ('pending', 'processing') AS started FROM r LEFT JOIN j USING (user_id, document_id, job_type)) AS z""")
def _(spark, d):
    jobs = _jobs(spark, d).groupBy(F.lit("u").alias("user_id"), "document_id", "job_type").agg(F.max_by("status", "event_id").alias("status"), F.count("*").cast("int").alias("attempt"), F.lit("").alias("error"))
    who = table(spark, d, "events").select(F.lit("u").alias("user_id"), F.col("user_id").alias("document_id")).distinct()
    asked = who.withColumn("job_type", F.explode(F.array(*map(F.lit, ["document_indexing", "malware_scan", "ocr"]))))
    return L.publish(jobs, asked, asked.where("document_id % 5 = 0").withColumn("reason", F.lit("no target")))


@query("L10_error_classes", "SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2) THEN 'deterministic' ELSE 'transient' END AS class FROM events")
def _(spark, d):
    states = F.array(*map(F.lit, ["22P02", "23505", "42601", "08006", "40001", None]))
    return table(spark, d, "events").select("event_id", L.error_class(F.element_at(states, (F.col("event_id") % 6 + 1).cast("int"))).alias("class"))


@query("L14_get_or_create", "SELECT source AS user_id, lang AS kb_id, bool_and(lang <> 'en') AS created, CASE WHEN lang = 'en' THEN min(doc_id) END AS old_id FROM documents GROUP BY source, lang")
def _(spark, d):
    docs = documents(spark, d)
    old = docs.where("kb_id = 'en'").groupBy(*KB).agg(F.min("document_id").alias("inquiry_id"))
    return L.get_or_create(old, docs).select(*KB, "created", F.when(~F.col("created"), F.col("inquiry_id")).alias("old_id"))


@query("G30_chunk_pair_relations", "SELECT doc_id, c AS chunk, p AS pair, CASE WHEN p = 1 THEN 'none' ELSE 'owns' END AS relation FROM documents, (SELECT unnest([1, 2]) AS c), (SELECT unnest([1, 2]) AS p)")
def _(spark, d):
    t = "RELATION: stray\nCHUNK: 1\nRELATION: no pair\nPAIR: 1\nRELATION: first\nRELATION: NONE\nPAIR: 2\nRELATION: Owns\nCHUNK: x\nPAIR: 3\nRELATION: lost\n CHUNK: 2 \nPAIR: 1\nRELATION:\nPAIR: two\nRELATION: lost\nPAIR: 2\nRELATION: OWNS "
    r = table(spark, d, "documents").select("doc_id", F.explode(B.numbered(F.concat(F.lit(t), F.lit("\nnoise "), "doc_id"), ["CHUNK", "PAIR"], "RELATION")).alias("x"))
    return r.select("doc_id", F.col("x.ids")[0].alias("chunk"), F.col("x.ids")[1].alias("pair"), B.relation_label(F.col("x.value")).alias("relation"))


@query("G30_candidate_verdicts", "SELECT doc_id, c AS candidate, c = 2 AS same FROM documents, (SELECT unnest([1, 2]) AS c)")
def _(spark, d):
    t = F.concat(F.lit("VERDICT: SAME\nCANDIDATE: 1\nVERDICT: DIFFERENT\nCANDIDATE: b\nVERDICT: SAME\nCANDIDATE: 2\nVERDICT: same\nnote "), "doc_id")
    r = table(spark, d, "documents").select("doc_id", F.explode(B.numbered(t, ["CANDIDATE"], "VERDICT")).alias("x"))
    return r.select("doc_id", F.col("x.ids")[0].alias("candidate"), (F.lower("x.value") == "same").alias("same"))


@query("G23_theme_parse", "SELECT doc_id, t.id, t.label, t.summary, t.size, 'All ' || doc_id AS note FROM (SELECT doc_id, unnest([{'id': 2, 'label': 'Ships', 'summary': 'Sails.', 'size': 5}, {'id': 1, 'label': 'Untitled theme', 'summary': '', 'size': 3}]) AS t FROM documents) AS q")
def _(spark, d):
    t = F.concat(F.lit("Well:\nCOMMUNITY: 2\nLABEL: Ships\nSUMMARY: Sails.\nCOMMUNITY: 9\nLABEL: Unknown\nCOMMUNITY: x\nLABEL: lost\nCOMMUNITY: 1\nNOTE: All "), "doc_id", F.lit("\nLABEL: after the note"))
    sizes = F.create_map(F.lit(1), F.lit(3), F.lit(2), F.lit(5))
    p = table(spark, d, "documents").select("doc_id", B.themes(t, sizes).alias("p"))
    return p.select("doc_id", F.explode("p.themes").alias("t"), "p.note").select("doc_id", "t.*", "note")


# Ground truth in files of a hundred pairs at most: each document of a knowledge base and the next one.
PAIRS = "SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS b, source || '/' || lang || '/' AS folder FROM documents"


def _ground_truth(spark, d):
    from ..sources.tables import ground_truth

    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("filename"))
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    p = docs.select("source", "lang", F.col("filename").alias("a"), F.lead("filename").over(w).alias("b"), F.floor((F.row_number().over(w) - 1) / 100).alias("part")).where("b is not null")
    files = p.groupBy("source", "lang", "part").agg(F.to_json(F.struct(F.collect_list(F.struct("a", "b")).alias("pairs"))).alias("value"))
    at = _place(spark)
    # A task writes some 64 files, however many there are.
    tasks = max(1, -(-docs.count() // 6400))
    files.repartition(tasks, "source", "lang", "part").select("value").write.option("maxRecordsPerFile", 1).text(at)
    return ground_truth(spark, at, "pairs", "a string, b string"), docs.select("filename", F.col("doc_id").alias("document_id"))


@query("S22_ground_truth", f"SELECT folder || a || '.txt' AS a, folder || b || '.txt' AS b FROM ({PAIRS}) AS q WHERE b IS NOT NULL")
def _(spark, d):
    return _ground_truth(spark, d)[0].select("a", "b")


@query("J18_ground_truth", f"SELECT folder || a || '.txt' AS pair_id, b AS document_id FROM ({PAIRS}) AS q WHERE b IS NOT NULL")
def _(spark, d):
    from ..operators.evaluation import resolve_names

    pairs, docs = _ground_truth(spark, d)
    return resolve_names(pairs.select(F.col("a").alias("pair_id"), F.col("b").alias("filename")), docs).select("pair_id", "document_id")
