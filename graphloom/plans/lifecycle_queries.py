"""Queries over jobs, sessions, messages, regions and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import CONTENT_TYPES, content_type, normalized
from ..operators import blocks as B
from ..operators import fulltext as FT
from ..operators import lifecycle as L
from ..operators import retrieval as R
from ..operators.fulltext import INDEX_SQL
from ..operators.model import windows
from ..sources.tables import documents, table
from .prelude import sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


NAMES = "doc_id || ['.txt', '.MD', '.pdf', '.png', '.jpeg', '.exe', ''][doc_id % 7 + 1]"
TYPES = "CASE regexp_extract(lower(name), '(\\.[^./]*)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONTENT_TYPES.items()) + " END"


def _files(spark, d):
    ext = F.element_at(F.array(*map(F.lit, [".txt", ".MD", ".pdf", ".png", ".jpeg", ".exe", ""])), (F.col("doc_id") % 7 + 1).cast("int"))
    f = table(spark, d, "documents").select("doc_id", F.concat("doc_id", ext).alias("name"))
    return f.withColumn("content_type", content_type(F.col("name")))


@query("S05_content_types", f"SELECT doc_id, name, {TYPES} AS content_type FROM (SELECT doc_id, {NAMES} AS name FROM documents) AS q")
def _(spark, d):
    return _files(spark, d)


@query("S06_pipeline_route", f"SELECT doc_id, CASE WHEN {TYPES} IN ('application/pdf', 'image/png', 'image/jpeg') THEN 'regions' ELSE 'plain' END AS route FROM (SELECT doc_id, {NAMES} AS name FROM documents) AS q WHERE {TYPES} IS NOT NULL")
def _(spark, d):
    f = _files(spark, d).where("content_type is not null")
    return f.select("doc_id", F.when(F.col("content_type").isin("application/pdf", "image/png", "image/jpeg"), "regions").otherwise("plain").alias("route"))


@query("P19_image_region", f"SELECT doc_id, 'figure' AS region_type FROM (SELECT doc_id, {NAMES} AS name FROM documents) AS q WHERE {TYPES} LIKE 'image/%'")
def _(spark, d):
    return _files(spark, d).where("content_type like 'image/%'").select("doc_id", F.lit("figure").alias("region_type"))


@query("P20_malware_gate", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'process' WHEN 3 THEN 'fail' ELSE 'reject' END AS action FROM documents")
def _(spark, d):
    k = F.col("doc_id") % 4
    s = F.when(k == 0, "NO_THREATS_FOUND").when(k == 1, "THREATS_FOUND").when(k == 2, "UNSUPPORTED")
    scans = table(spark, d, "documents").select("doc_id", s.alias("result"))
    return scans.select("doc_id", F.when(F.col("result") == "NO_THREATS_FOUND", "process").when(F.col("result").isNull(), "fail").otherwise("reject").alias("action"))


REG = "SELECT page_id, ['describe', 'confirm_scan', NULL][page_id % 3 + 1] AS needs, ['native_text', 'native_table', 'unconfirmed_table', 'figure'][page_id % 4 + 1] AS kind, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS txt FROM pages"


def _regions(spark, d):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % k + 1).cast("int"))
    r = table(spark, d, "pages").select("page_id", pick(["describe", "confirm_scan", None], 3).alias("needs"), pick(["native_text", "native_table", "unconfirmed_table", "figure"], 4).alias("kind"), F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url")).alias("txt"))
    t, s = L.resolve_region(F.col("needs"), F.col("kind"), F.col("txt"))
    return r.select("page_id", t.alias("region_type"), s.alias("status"))


RES = f"SELECT page_id, CASE WHEN needs = 'describe' THEN 'figure' WHEN needs = 'confirm_scan' THEN CASE WHEN kind = 'unconfirmed_table' THEN 'scanned_table' ELSE 'scanned_text' END WHEN kind = 'native_table' THEN 'native_table' ELSE 'native_text' END AS region_type, CASE WHEN needs IS NULL AND txt <> '' THEN 'indexed' ELSE 'skipped' END AS status FROM ({REG}) AS q"


@query("P18_region_resolution", RES)
def _(spark, d):
    return _regions(spark, d)


@query("A12_manifest_summary", f"SELECT page_id % 10 AS document_id, count(*) FILTER (WHERE status = 'indexed') AS indexed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed FROM ({RES}) AS z GROUP BY 1")
def _(spark, d):
    c = lambda s: F.count_if(F.col("status") == s).alias(s)
    return _regions(spark, d).groupBy((F.col("page_id") % 10).alias("document_id")).agg(c("indexed"), c("skipped"), c("failed"))


@query("S16_regions_in_order", "SELECT page_id, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id % 3, (page_id * 37 % 100) / 100.0, page_id) AS place FROM pages")
def _(spark, d):
    box = F.concat(F.lit('{"y0": '), ((F.col("page_id") * 37 % 100) / 100).cast("string"), F.lit("}"))
    w = Window.partitionBy(F.col("page_id") % 10).orderBy(F.col("page_id") % 3, F.get_json_object("box", "$.y0").cast("double"), "page_id")
    return table(spark, d, "pages").withColumn("box", box).select("page_id", F.row_number().over(w).alias("place"))


@query("W06_ordinals_across_regions", "SELECT page_id, part, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id, part) - 1 AS ordinal FROM (SELECT page_id, unnest(range(page_id % 3 + 1)) AS part FROM pages) AS q")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("page_id") % 3)).alias("part"))
    return p.select("page_id", "part", (F.row_number().over(Window.partitionBy(F.col("page_id") % 10).orderBy("page_id", "part")) - 1).alias("ordinal"))


@query("S04_table_rows", "SELECT l_orderkey, string_agg(coalesce(l_returnflag, '') || ' | ' || coalesce(l_linestatus, '') || ' | ' || l_linenumber, chr(10) ORDER BY l_linenumber, coalesce(l_returnflag, '') || ' | ' || coalesce(l_linestatus, '')) AS text FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    row = F.array_join(F.transform(F.array("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")), lambda x: F.coalesce(x, F.lit(""))), " | ")
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("r"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda x: x["r"]), "\n").alias("text"))


JOB = "SELECT event_id, user_id AS document_id, event_id % 2 = 0 AS has_layout, ['pending', 'processing', 'succeeded', 'failed'][event_id % 4 + 1] AS status, ['region_classification', 'document_indexing', 'entity_extraction', 'edge_extraction', 'canonicalization', 'malware_scan'][event_id % 6 + 1] AS job_type, CASE WHEN event_id % 5 = 0 THEN 'embedding' ELSE '' END AS phase FROM events"


def _jobs(spark, d):
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % k + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("document_id"), (F.col("event_id") % 2 == 0).alias("has_layout"), pick(["pending", "processing", "succeeded", "failed"], 4).alias("status"), pick(["region_classification", "document_indexing", "entity_extraction", "edge_extraction", "canonicalization", "malware_scan"], 6).alias("job_type"), F.when(F.col("event_id") % 5 == 0, "embedding").otherwise("").alias("phase"))


@query("P14_active_jobs", f"SELECT event_id, document_id FROM ({JOB}) AS q WHERE status IN ('pending', 'processing')")
def _(spark, d):
    return _jobs(spark, d).where(F.col("status").isin(*L.ACTIVE)).select("event_id", "document_id")


STG = f"SELECT document_id, has_layout, CASE WHEN job_type = 'region_classification' AND phase = 'embedding' THEN 'embedding' WHEN job_type = 'region_classification' THEN 'analyzing' WHEN job_type = 'document_indexing' THEN 'embedding' WHEN job_type = 'malware_scan' THEN 'scanning' ELSE 'entities' END AS stage FROM ({JOB}) AS q WHERE status IN ('pending', 'processing')"
ACT = f"SELECT document_id, has_layout, list_filter(CASE WHEN has_layout THEN ['scanning', 'analyzing', 'embedding', 'entities', 'complete'] ELSE ['scanning', 'embedding', 'entities', 'complete'] END, lambda x: list_contains(p, x)) AS stages FROM (SELECT document_id, has_layout, list(DISTINCT stage) AS p FROM ({STG}) AS s GROUP BY ALL) AS z"


@query("T05_active_stages", ACT)
def _(spark, d):
    return L.active_stages(_jobs(spark, d))


def _ring(spark, d):
    full = F.array(*map(F.lit, L.STAGES_LAYOUT))
    return L.active_stages(_jobs(spark, d)).where("has_layout").withColumn("all", full)


FIRST = f"SELECT document_id, stages, CASE WHEN len(stages) = 0 THEN NULL ELSE list_position(['scanning', 'analyzing', 'embedding', 'entities', 'complete'], stages[1]) END AS pos FROM ({ACT}) AS a WHERE has_layout"


@query("L11_status_ring", f"SELECT document_id, round(coalesce((pos - 0.5) / 5, 0)::DOUBLE, 6) AS fraction FROM ({FIRST}) AS f")
def _(spark, d):
    return _ring(spark, d).select("document_id", F.round(L.ring(F.lit("processing"), F.col("all"), F.col("stages")), 6).alias("fraction"))


@query("L12_stage_states", f"SELECT document_id, list_transform(['scanning', 'analyzing', 'embedding', 'entities', 'complete'], lambda x, i: x || ':' || CASE WHEN list_contains(stages, x) THEN 'active' WHEN pos IS NOT NULL AND i < pos THEN 'done' ELSE 'upcoming' END) AS states FROM ({FIRST}) AS f")
def _(spark, d):
    return _ring(spark, d).select("document_id", L.stage_states(F.col("all"), F.col("stages")).alias("states"))


@query("L04_delete_guard", f"SELECT doc_id, doc_id NOT IN (SELECT document_id FROM ({JOB}) AS q WHERE status IN ('pending', 'processing')) AS deletable FROM documents")
def _(spark, d):
    busy = _jobs(spark, d).where(F.col("status").isin(*L.ACTIVE)).select(F.col("document_id").alias("doc_id")).distinct().withColumn("busy", F.lit(True))
    return table(spark, d, "documents").select("doc_id").join(busy, "doc_id", "left").select("doc_id", F.col("busy").isNull().alias("deletable"))


# A session is a user's events of one day; the clock stands three hours after the last event of all.
SES = "SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS created, max(ts) AS seen, count(*) % 2 = 0 AS warned FROM events GROUP BY user_id, CAST(ts AS DATE)"
NOW = "(SELECT max(ts) + INTERVAL 3 HOUR FROM events)"


def _sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("created"), F.max("ts").alias("seen"), (F.count("*") % 2 == 0).alias("warned"))
    return s.crossJoin(F.broadcast(e.agg((F.max("ts") + F.expr("interval 3 hours")).alias("now"))))  # one row


@query("P15_session_state", f"SELECT user_id, day, CASE WHEN {NOW} >= e THEN 'expired' WHEN {NOW} >= e - INTERVAL 15 MINUTE AND NOT warned THEN 'warn' ELSE 'live' END AS state FROM (SELECT *, least(created + INTERVAL 24 HOUR, seen + INTERVAL 6 HOUR) AS e FROM ({SES}) AS s) AS z")
def _(spark, d):
    return _sessions(spark, d).select("user_id", "day", L.session_state(F.col("now"), F.col("created"), F.col("seen"), F.col("warned")).alias("state"))


@query("L08_account_status", f"SELECT user_id, day, date_diff('second', TIMESTAMP '2024-01-01', least(created + INTERVAL 24 HOUR, seen + INTERVAL 6 HOUR)) AS expires FROM ({SES}) AS s")
def _(spark, d):
    end = F.least(F.col("created") + F.expr("interval 24 hours"), F.col("seen") + F.expr("interval 6 hours"))
    return _sessions(spark, d).select("user_id", "day", (F.unix_seconds(F.date_trunc("second", end)) - F.unix_seconds(F.expr("timestamp'2024-01-01'"))).alias("expires"))


QUERIES["T06_session_sweep"] = lambda spark, d: QUERIES["P15_session_state"](spark, d).groupBy("state").agg(F.count("*").alias("n"))
ORACLES["T06_session_sweep"] = f"SELECT state, count(*) AS n FROM ({ORACLES['P15_session_state']}) AS z GROUP BY state"


@query("P16_query_validation", "SELECT conv_id, turn, text <> '' AND octet_length(encode(text)) <= 4000 AS ok FROM conversations WHERE role = 'user'")
def _(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", ((F.col("text") != "") & (F.octet_length("text") <= 4000)).alias("ok"))


MSG = "SELECT conv_id, conv_id * 1000 + turn AS message_id, turn AS ordinal, role, text FROM conversations WHERE role <> 'system'"


def _messages(spark, d):
    return table(spark, d, "conversations").where("role <> 'system'").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.col("turn").alias("ordinal"), "role", "text")


@query("W07_preceding_query", f"SELECT message_id, CASE WHEN pr = 'user' THEN pm END AS query_id FROM (SELECT *, lag(role) OVER w AS pr, lag(message_id) OVER w AS pm FROM ({MSG}) AS m WINDOW w AS (PARTITION BY conv_id ORDER BY ordinal, message_id)) AS z WHERE role = 'assistant'")
def _(spark, d):
    w = Window.partitionBy("conv_id").orderBy("ordinal", "message_id")
    m = _messages(spark, d).withColumn("pr", F.lag("role").over(w)).withColumn("pm", F.lag("message_id").over(w))
    return m.where("role = 'assistant'").select("message_id", F.when(F.col("pr") == "user", F.col("pm")).alias("query_id"))


@query("G31_turns", f"WITH m AS ({MSG}), a AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN lag(message_id) OVER (PARTITION BY conv_id ORDER BY ordinal, message_id) END AS sup FROM m WHERE role = 'assistant'), p AS (SELECT *, lag(role) OVER w AS pr, lag(message_id) OVER w AS pm FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY ordinal, message_id)), r AS (SELECT a.conv_id, a.message_id, a.sup, max(CASE WHEN sup IS NULL THEN a.message_id END) OVER (PARTITION BY a.conv_id ORDER BY a.ordinal, a.message_id) AS root FROM a), q AS (SELECT message_id AS root, CASE WHEN pr = 'user' THEN pm END AS query FROM p WHERE message_id IN (SELECT message_id FROM a WHERE sup IS NULL)) SELECT r.conv_id, r.root, q.query, count(*) AS answers FROM r JOIN q USING (root) GROUP BY ALL UNION ALL SELECT conv_id, NULL, message_id, 0 FROM m WHERE role = 'user' AND message_id NOT IN (SELECT query FROM q WHERE query IS NOT NULL)")
def _(spark, d):
    w = Window.partitionBy("conv_id", "role").orderBy("ordinal", "message_id")
    m = _messages(spark, d).withColumn("supersedes", F.when((F.col("role") == "assistant") & (F.col("ordinal") % 3 == 0), F.lag("message_id").over(w)))
    return L.turns(m).select("conv_id", "root", "query", F.size("answers").cast("long").alias("answers"))


@query("A18_next_ordinal", f"SELECT conv_id, max(ordinal) + 1 AS next_ordinal FROM ({MSG}) AS m GROUP BY conv_id")
def _(spark, d):
    return _messages(spark, d).groupBy("conv_id").agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("next_ordinal"))


@query("L14_inquiry_messages", f"SELECT m.message_id, m.ordinal, coalesce(d.source, '') AS file_name FROM ({MSG}) AS m LEFT JOIN documents d ON d.doc_id = m.conv_id * 3")
def _(spark, d):
    names = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("file_name"))
    return R.file_names(_messages(spark, d).withColumn("document_id", F.col("conv_id") * 3), names).select("message_id", "ordinal", "file_name")


QUERIES["J17_file_names"] = lambda spark, d: QUERIES["L14_inquiry_messages"](spark, d).groupBy("file_name").agg(F.count("*").alias("n"))
ORACLES["J17_file_names"] = f"SELECT file_name, count(*) AS n FROM ({ORACLES['L14_inquiry_messages']}) AS z GROUP BY file_name"


@query("K10_cursor_page", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01') > 50 AS has_more FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def _(spark, d):
    import datetime

    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return L.page(o.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], (datetime.datetime(1995, 1, 1), 1 << 60), 50).select("o_orderkey", "has_more")


@query("K12_upload_quota", "SELECT source AS user_id, count(*) AS n, count(*) < 20 AS may_upload FROM documents GROUP BY source")
def _(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("user_id")).agg(F.count("*").alias("n"), (F.count("*") < 20).alias("may_upload"))


@query("A13_usage_stats", "SELECT event_type, count(*) AS n, round(CASE WHEN count(value) > 0 THEN sum(value) / count(value) ELSE 0 END, 4) AS average FROM events GROUP BY event_type")
def _(spark, d):
    n = F.count("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.when(n > 0, F.sum("value") / n).otherwise(0.0), 4).alias("average"))


@query("A20_cited_pages", "SELECT conv_id, list_sort(list(DISTINCT turn % 4)) AS pages FROM conversations GROUP BY conv_id")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set(F.col("turn") % 4)).alias("pages"))


@query("A21_incomplete", f"SELECT event_id, status FROM ({JOB}) AS q WHERE status <> 'succeeded'")
def _(spark, d):
    return _jobs(spark, d).where("status <> 'succeeded'").select("event_id", "status")


@query("A15_qa_scores", "SELECT count(*) AS questions, round(avg(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END), 6) AS retrieval_score, round(avg(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END), 6) AS answer_score FROM conversations")
def _(spark, d):
    from ..operators.evaluation import qa_scores

    s = qa_scores(table(spark, d, "conversations").select((F.col("turn") % 2 == 0).alias("retrieved"), (F.col("turn") % 3 == 0).alias("correct")))
    return s.select("questions", F.round("retrieval_score", 6).alias("retrieval_score"), F.round("answer_score", 6).alias("answer_score"))


@query("L02_set_embedding", "SELECT vec_id, vec_id % 5 = 0 AS replaced FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    new = e.where("vec_id % 5 = 0").select("vec_id", F.array(F.lit(0.5).cast("float")).alias("fresh"))
    return e.join(new, "vec_id", "left").select("vec_id", (F.element_at(F.coalesce("fresh", "embedding"), 1) == F.coalesce(F.element_at("fresh", 1), F.lit(-9.0))).alias("replaced"))


@query("L07_tenant_delete", "SELECT doc_id FROM documents WHERE source <> 'src0'")
def _(spark, d):
    gone = spark.createDataFrame([("src0",)], "source string")
    return table(spark, d, "documents").join(F.broadcast(gone), "source", "left_anti").select("doc_id")


LIMITER = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f(key, id, r, stop, n) AS (SELECT key, id, r, t + 3600000000, 1 FROM e WHERE r = 1 UNION ALL SELECT e.key, e.id, e.r, CASE WHEN f.stop < e.t THEN e.t + 3600000000 ELSE f.stop END, CASE WHEN f.stop < e.t THEN 1 ELSE f.n + 1 END FROM f JOIN e ON e.key = f.key AND e.r = f.r + 1)
SELECT key, id, n <= 1 AS allowed FROM f"""


@query("T01_rate_limiter", LIMITER)
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    return L.allowed_window(e, 1, 3600)


QUERIES["W01_leg_rank"] = lambda spark, d: R.ranked(table(spark, d, "conversations").select("conv_id", "turn", "role"), [F.desc("turn"), "role"], by=["conv_id"]).select("conv_id", "turn", "role", "rank")
ORACLES["W01_leg_rank"] = "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS rank FROM conversations"


@query("G05_normalize", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS t FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", normalized(F.col("p_name"), True).alias("t"))


@query("G30_relation_blocks", "SELECT doc_id, 'p' || doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE 'owns' END AS value FROM documents")
def _(spark, d):
    t = F.concat(F.lit("noise\nRELATION: stray\nPAIR: p"), "doc_id", F.lit("\nrelation: "), F.when(F.col("doc_id") % 3 == 0, "NONE").otherwise("Owns"))
    b = table(spark, d, "documents").select("doc_id", F.explode(B.blocks(t, "PAIR", "RELATION")).alias("b"))
    return b.select("doc_id", "b.key", B.relation_label(F.col("b.value")).alias("value"))


@query("R10_answer_parse", "SELECT doc_id, 'Sum ' || doc_id AS summary, CASE WHEN doc_id % 2 = 0 THEN [2, 1] ELSE [3] END AS cited FROM documents")
def _(spark, d):
    a = F.concat(F.lit("Sum "), "doc_id", F.lit("\nCitations: "), F.when(F.col("doc_id") % 2 == 0, "2, 1,2, 9, x").otherwise("3"))
    return R.parse_answer(table(spark, d, "documents").withColumn("a", a), F.lit(4), F.col("a")).select("doc_id", F.regexp_replace("summary", "\\s+$", "").alias("summary"), "cited")


@query("R11_visible_stream", "SELECT conv_id AS answer_id, string_agg(text, '' ORDER BY turn, role) AS visible FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("answer_id"), F.struct("turn", "role").alias("seq"), F.col("text").alias("delta"))
    end = c.groupBy("answer_id").agg(F.max("seq").alias("m")).select("answer_id", F.struct((F.col("m.turn") + 1).alias("turn"), F.col("m.role").alias("role")).alias("seq"), F.lit("CITATIONS: 1").alias("delta"))
    return B.visible(c.unionByName(end))


@query("R12_no_context", "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'answer' ELSE 'I could not find relevant information to answer this question.' END AS summary FROM (SELECT DISTINCT conv_id FROM conversations) AS q")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id").distinct().withColumn("chunks", F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return c.select("conv_id", F.when(F.size("chunks") == 0, R.NOT_FOUND).otherwise("answer").alias("summary"))


def _index(spark, d):
    from ..operators.model import Model

    return Model(spark, d).fulltext()


# One row a passage that has any of the terms, with the places of each.
_PLACES = "m AS (SELECT user_id, kb_id, chunk_id, {terms} FROM posting WHERE term IN ({names}) GROUP BY user_id, kb_id, chunk_id)"


def _places(*terms):
    return INDEX_SQL + ", " + _PLACES.format(terms=", ".join(f"any_value(positions) FILTER (WHERE term = '{t}') AS {t}" for t in terms), names=", ".join(f"'{t}'" for t in terms))


@query("P03_full_text_match", sql("SELECT user_id, kb_id, chunk_id FROM m WHERE len(list_intersect(licens, list_transform(apach, lambda x: x - 3))) > 0 OR (releas IS NOT NULL AND version IS NULL)", "passages", extra=_places("licens", "apach", "releas", "version")))
def _(spark, d):
    return FT.search(_index(spark, d), '"licensed under the apache" or releases -versions').select("user_id", "kb_id", "chunk_id")


@query("R13_web_query", sql("SELECT user_id, kb_id, chunk_id FROM m WHERE (er IS NOT NULL AND licens IS NULL) OR (len(list_intersect(gener, list_transform(public, lambda x: x - 1))) > 0 AND licens IS NOT NULL)", "passages", extra=_places("er", "licens", "gener", "public")))
def _(spark, d):
    return FT.search(_index(spark, d), 'ering -license or "general public" LICENSES').select("user_id", "kb_id", "chunk_id")


_SERIES = "coalesce(list_sum(list_transform(range(1, len({t}) + 1), lambda i: 1.0::DOUBLE / (i * i))), 0)"


@query("K02_full_text_top_k", sql(f"SELECT * FROM (SELECT user_id, kb_id, chunk_id, score, row_number() OVER (PARTITION BY user_id, kb_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT user_id, kb_id, chunk_id, round((0.1::DOUBLE / 1.64493406685) * ({_SERIES.format(t='thing')} + {_SERIES.format(t='licens')} + {_SERIES.format(t='sting')}) / 3, 9) AS score FROM m) AS q) AS z WHERE rank <= 12", "passages", extra=_places("thing", "licens", "sting")))
def _(spark, d):
    return FT.top(_index(spark, d), "things or licensing or sting", 12)


@query("K02_near_words_top_k", sql("SELECT * FROM (SELECT user_id, kb_id, chunk_id, score, row_number() OVER (PARTITION BY user_id, kb_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT user_id, kb_id, chunk_id, round(1 - coalesce(exp(list_sum(list_transform(list_filter(flatten(list_transform(en, lambda x: list_transform(er, lambda y: abs(x - y)))), lambda v: v > 0), lambda v: ln(1 - 0.1::DOUBLE * sqrt(CASE WHEN v > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05::DOUBLE * exp(v / 1.5::DOUBLE - 2)) END))))), 1), 9) AS score FROM m WHERE en IS NOT NULL AND er IS NOT NULL) AS q) AS z WHERE rank <= 12", "passages", extra=_places("en", "er")))
def _(spark, d):
    return FT.top(_index(spark, d), "en er", 12)


@query("J16_one_query_lateral", sql("SELECT p.chunk_id, m.chunk_id IS NOT NULL AS hit FROM passages p LEFT JOIN m USING (user_id, kb_id, chunk_id)", "passages", extra=_places("thing")))
def _(spark, d):
    # The query is parsed and stemmed once, and meets the passages by the index.
    hits = FT.search(_index(spark, d), "things").select("user_id", "kb_id", "chunk_id", F.lit(True).alias("hit"))
    return windows(documents(spark, d)).join(hits, ["user_id", "kb_id", "chunk_id"], "left").select("chunk_id", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("S01_whole_documents", "SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@query("S18_knowledge_bases", "SELECT source AS user_id, lang AS kb_id, count(*) AS documents FROM documents GROUP BY source, lang")
def _(spark, d):
    return documents(spark, d).groupBy("user_id", "kb_id").agg(F.count("*").alias("documents"))


@query("S24_event_lines", "SELECT conv_id, turn, role, 'event: delta' || chr(10) || 'data: {\"turn\":' || turn || '}' || chr(10) || chr(10) AS line FROM conversations")
def _(spark, d):
    body = F.to_json(F.struct("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("event: delta\ndata: "), body, F.lit("\n\n")).alias("line"))


@query("T02_expired_counters", "SELECT user_id AS key FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("m"))
    return e.where("m + interval 1 hour >= timestamp'2024-01-30 12:00:00' - interval 1 hour").select("key")


@query("T09_scan_timeout", f"SELECT event_id, CASE WHEN status = 'pending' AND event_id % 100 >= 60 THEN 'failed' ELSE status END AS status FROM ({JOB}) AS q")
def _(spark, d):
    late = (F.col("status") == "pending") & (F.col("event_id") % 100 >= 60)
    return _jobs(spark, d).select("event_id", F.when(late, "failed").otherwise(F.col("status")).alias("status"))


@query("L15_snapshot_overwrite", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS version FROM documents")
def _(spark, d):
    from ..sources.tables import replace_documents

    old = table(spark, d, "documents").select("doc_id", "lang", F.lit("old").alias("version"))
    return replace_documents(old, old.where("lang = 'en'").withColumn("version", F.lit("new")), "lang").select("doc_id", "version")
