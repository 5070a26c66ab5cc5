"""Vector, keyword and graph legs, their fusion, and answers with citations.

Legs work on all knowledge bases at once and rank inside each, so one plan serves many
tenants. Ties are broken by id everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import KB

RRF_K = 60
TOP = 12
SEED_LENGTH = 3


def norm(e: Column) -> Column:
    return F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 if either vector is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot / n)


def searchable(vectors: DataFrame, width: int) -> DataFrame:
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == width))


def vector_top(vectors: DataFrame, query: list[float], k: int = TOP) -> DataFrame:
    """The ``k`` vectors nearest to ``query``: ``id, score, rank``. Exact; a heap per task and one merge."""
    if k <= 0 or not query:
        raise ValueError("k must be positive and the query vector not empty")
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = searchable(vectors, len(query)).select("id", cosine(F.col("embedding"), q).alias("score"))
    top = scored.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def keyword_match(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that hold the query text, without regard to case."""
    return chunks.where(F.lower("text").contains(query.lower()))


def ranked(df: DataFrame, order: list, by: list[str] = KB, k: int | None = None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def fuse(legs: list[DataFrame], key: str = "chunk_id", by: list[str] = KB, k: int | None = TOP, const: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of ``1 / (const + rank)`` over the legs, in leg order; the best ``k`` of each group."""
    union = None
    for i, leg in enumerate(legs):
        part = leg.select(*by, key, F.lit(i).alias("leg"), "rank")
        union = part if union is None else union.unionByName(part)
    parts = F.sort_array(F.collect_list(F.struct("leg", "rank")))
    score = F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.lit(1.0) / (F.lit(const) + x["rank"]))
    fused = union.groupBy(*by, key).agg(score.alias("score"))
    return ranked(fused, [F.desc("score"), key], by, k if k and k > 0 else None)


def seeds(canon: DataFrame, query: str) -> DataFrame:
    """Identities whose normalized text stands in the query (literally, not as a pattern)."""
    return canon.where((F.length("normalized_text") >= SEED_LENGTH) & F.lit(query.lower()).contains(F.col("normalized_text")))


def seed_mentions(resolved: DataFrame, seed: DataFrame) -> DataFrame:
    return resolved.join(seed.select("canonical_id"), "canonical_id", "left_semi").select("mention_id", *KB)


def ends(e: DataFrame) -> DataFrame:
    """Each edge twice, once for either end: an equi-join on ``mention_id`` then replaces ``a = s OR b = s``."""
    pair = F.array(F.struct(F.col("a").alias("mention_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("mention_id"), F.col("a").alias("other")))
    return e.select("chunk_id", *KB, "co_occurrence_count", F.explode(pair).alias("p")).select("chunk_id", *KB, "co_occurrence_count", "p.mention_id", "p.other")


def seed_edges(resolved: DataFrame, e: DataFrame, seed: DataFrame) -> DataFrame:
    """Edges that touch a seed mention; one with two seed ends counts twice."""
    return ends(e).join(seed_mentions(resolved, seed).select("mention_id"), "mention_id")


def two_hops(resolved: DataFrame, e: DataFrame, seed: DataFrame) -> DataFrame:
    """``chunk_id`` of the windows with an edge of an identity that a seed's edge leads to, without those with a seed's edge.

    The seeds' edges are found once and written to the shared folder. A mention lies in one
    window, which its edges share, so mentions are asked whether they have an edge, and
    edges aren't sent by either end once more.
    """
    from ..sources.lineage import cut

    touch = cut(seed_edges(resolved, e, seed).select("chunk_id", "other").distinct())
    identity = resolved.select("mention_id", "canonical_id", "chunk_id")
    hop1 = touch.select(F.col("other").alias("mention_id")).distinct()
    siblings = identity.join(hop1, "mention_id", "left_semi").select("canonical_id").distinct()
    expanded = identity.join(siblings, "canonical_id", "left_semi")
    linked = ends(e).select("mention_id").distinct()
    return expanded.join(linked, "mention_id", "left_semi").select("chunk_id").distinct().join(touch.select("chunk_id").distinct(), "chunk_id", "left_anti")


def aggregation_leg(canon: DataFrame, resolved: DataFrame, e: DataFrame, query: str, k: int = TOP) -> DataFrame:
    """Chunks by the weight of the edges that touch seeds in them: ``user_id, kb_id, chunk_id, weight, rank``."""
    w = seed_edges(resolved, e, seeds(canon, query)).groupBy(*KB, "chunk_id").agg(F.sum("co_occurrence_count").alias("weight"))
    return ranked(w, [F.desc("weight"), "chunk_id"], k=k)


def traversal_leg(canon: DataFrame, resolved: DataFrame, e: DataFrame, cross: DataFrame, query: str, k: int = TOP) -> DataFrame:
    """Chunks two hops from the seeds, or linked to a seed across chunks, without the seeds' own chunks."""
    seed = seeds(canon, query)
    touch = seed_edges(resolved, e, seed)
    own = touch.select("chunk_id").distinct()
    hop1 = touch.select(F.col("other").alias("mention_id")).distinct()
    identity = resolved.select("mention_id", "canonical_id", "chunk_id", *KB)
    siblings = identity.join(hop1, "mention_id", "left_semi").select("canonical_id").distinct()
    expanded = identity.join(siblings, "canonical_id", "left_semi").select("mention_id")
    hop2 = ends(e).join(expanded, "mention_id", "left_semi").select(*KB, "chunk_id")
    # a in seeds: the other side is b; else a. Both joins are on one key each.
    ids = seed.select(F.col("canonical_id").alias("a"), F.lit(True).alias("in_a"))
    jds = seed.select(F.col("canonical_id").alias("b"), F.lit(True).alias("in_b"))
    linked = cross.where("relation_type <> 'none'").join(ids, "a", "left").join(jds, "b", "left").where("in_a or in_b")
    other = linked.select(F.when(F.col("in_a"), F.col("b")).otherwise(F.col("a")).alias("canonical_id")).distinct()
    across = identity.join(other, "canonical_id", "left_semi").select(*KB, "chunk_id")
    reach = hop2.union(across).distinct().join(own, "chunk_id", "left_anti")
    return ranked(reach, ["chunk_id"], k=k)


def route(query: Column) -> Column:
    """A stand-in for a routing model: counting words go to the aggregation leg, connecting words to the traversal leg."""
    q = F.lower(query)
    return F.when(q.rlike("how many|most often|summari[sz]e|overall|main "), "aggregation").when(q.rlike("connect|relate|between|link|through"), "multi_hop").otherwise("normal")


def route_of(spark, query: str, router=route) -> str:
    """The route of one query; what a router doesn't know is ``normal``."""
    found = spark.range(1).select(router(F.lit(query)).alias("r")).first().r
    return found if found in ("aggregation", "multi_hop") else "normal"


def full_search(canon: DataFrame, resolved: DataFrame, e: DataFrame, cross: DataFrame, query: str, legs: list[DataFrame], k: int = TOP, router=route) -> DataFrame:
    """The hybrid of ``legs``, fused anew with the graph leg that the query's route asks for; a ``normal`` query has none."""
    hybrid = fuse(legs, k=k)
    to = route_of(canon.sparkSession, query, router)
    if to == "aggregation":
        return fuse([hybrid, aggregation_leg(canon, resolved, e, query, k)], k=k)
    if to == "multi_hop":
        return fuse([hybrid, traversal_leg(canon, resolved, e, cross, query, k)], k=k)
    return hybrid


def file_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``file_name``, empty where the document is gone."""
    return df.join(names.select("document_id", "file_name"), "document_id", "left").withColumn("file_name", F.coalesce("file_name", F.lit("")))


def retrieved_documents(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents by the first place of any of their chunks in the fused order."""
    first = fused.join(chunks.select("chunk_id", "document_id"), "chunk_id").groupBy(*KB, "document_id").agg(F.min("rank").alias("first_rank"))
    return ranked(first, ["first_rank"])


def prompt(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """One context string a knowledge base: numbered passages with their source."""
    c = fused.join(chunks.select("chunk_id", "document_id", "char_start", "char_end", "text"), "chunk_id")
    head = F.concat(F.lit("["), F.col("rank"), F.lit("] (document:"), F.col("document_id"), F.lit(" chars:"), F.col("char_start"), F.lit("-"), F.col("char_end"), F.lit(")\n"), F.col("text"), F.lit("\n\n"))
    return c.groupBy(*KB).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", head.alias("t")))), lambda x: x["t"]), "").alias("context"))


# Fixed value: what the generator says when nothing was found.
NOT_FOUND = "I could not find relevant information to answer this question."


def parse_answer(df: DataFrame, n_chunks: Column, response: Column) -> DataFrame:
    """Adds ``summary`` and ``cited``: the text before the last footer, and its valid numbers in order, once each."""
    at = F.length(response) - F.instr(F.reverse(F.lower(response)), ":snoitatic") - 9
    has = F.lower(response).contains("citations:")
    tail = F.substring(response, at + 11, F.length(response))
    numbers = F.array_distinct(F.filter(F.transform(F.split(tail, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull() & (x >= 1) & (x <= n_chunks)))
    found = F.trim(response) != NOT_FOUND
    return df.withColumn("summary", F.when(has & found, F.trim(F.substring(response, F.lit(1), at))).otherwise(F.trim(response))).withColumn("cited", F.when(has & found, numbers).otherwise(F.array().cast("array<int>")))


#: Queries that a task compares at once, vectors that meet them at once.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` vectors nearest to each query (``query_id, q``) by cosine to six digits, ties by id.

    Queries are dealt to blocks of about ``block`` and vectors to blocks of about
    ``VECTOR_BLOCK``, packed as flat arrays; each pair of blocks is one product of matrices
    and hands on ``k`` rows a query at most. All pairs are compared, so the work is the
    product of both numbers. A zero or empty side scores
    0; a null side or component and two widths score null, which comes last; NaN comes first.
    """
    deal = lambda df, name, n: df.withColumn("_block", F.pmod(F.xxhash64(name), F.lit(max(1, -(-df.count() // n)))))
    packed = lambda df, name, own, flat: df.groupBy("_block").agg(F.collect_list(F.struct(own, F.col(name).cast("array<double>").alias("e"))).alias("x")).select(F.col(f"x.{own}").alias(own), F.col("x.e").alias(flat))
    q = packed(deal(queries, "query_id", block), "q", "query_id", "asked")
    v = packed(deal(vectors.select("vec_id", "embedding"), "vec_id", VECTOR_BLOCK), "embedding", "vec_id", "held")
    kinds = {c: t.schema[c].dataType.simpleString() for t, c in ((queries, "query_id"), (vectors, "vec_id"))}

    def dense(column: pa.ListScalar) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By width, the places of rows without nulls, the rows and their lengths."""
        rows = column.values
        sizes = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False)
        gaps = np.array([bool(r.values.null_count) if r.is_valid else True for r in rows], bool) if rows.flatten().null_count else sizes < 0
        out = {}
        for w in np.unique(sizes[~gaps]).tolist():
            at = np.flatnonzero((sizes == w) & ~gaps)
            m = rows.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), w)
            out[w] = at, m, np.sqrt((m * m).sum(axis=1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                query, vec = b.column(0)[i].values, b.column(2)[i].values
                asked, held = dense(b.column(1)[i]), dense(b.column(3)[i])
                ids = vec.to_numpy(zero_copy_only=False)
                for first in range(0, len(query), 256):
                    # A pair that has no score is below all others; NaN is above them, as in Spark's order.
                    score = np.full((min(256, len(query) - first), len(vec)), -np.inf)
                    for w, (at, m, n) in asked.items():
                        mine = (at >= first) & (at < first + 256)
                        for x, (to, other, length) in held.items():
                            both = n[mine, None] * length
                            dot = m[mine] @ other.T if w == x else -np.inf
                            cos = np.divide(dot, both, out=np.zeros_like(both), where=both != 0) if w == x else np.where(both == 0, 0.0, dot)
                            score[np.ix_(at[mine] - first, to)] = np.round(cos, 6) + 0.0
                    rows, cols = _k_best(np.where(np.isnan(score), np.inf, score), ids, k)
                    found = score[rows, cols]
                    yield pa.RecordBatch.from_arrays([query.take(pa.array(rows + first)), vec.take(pa.array(cols)), pa.array(found, mask=found == -np.inf)], names=["query_id", "vec_id", "score"])

    s = q.crossJoin(v).select("query_id", "asked", "vec_id", "held").mapInArrow(run, f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double")
    return ranked(s, [F.desc("score"), "vec_id"], by=["query_id"], k=k).drop("rank")


def _k_best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` best by score, then id."""
    rows, cols = [], []
    for i, r in enumerate(score):
        near = np.flatnonzero(r >= np.partition(r, len(r) - k)[len(r) - k]) if len(r) > k else np.arange(len(r))
        near = near[np.lexsort((ids[near], -r[near]))[:k]]
        rows.append(np.full(len(near), i))
        cols.append(near)
    return np.concatenate(rows), np.concatenate(cols)
