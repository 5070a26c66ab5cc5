"""Coherence tests by an intruder, and retrieval scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized
from .model import KB

LEAST_MEMBERS, SHOWN, MOST_COMMUNITIES, SEED = 3, 4, 30, 42


def intrusion_sets(nodes: DataFrame, seed: int = SEED) -> DataFrame:
    """``user_id, kb_id, community_id, shown, intruder`` for each testable community.

    Communities of three members or more take part, at least two of them, the first thirty
    by id. Four members are shown, most mentioned first, with one of another community,
    drawn from all its members by a hash of the seed and the ids; the shown items are ordered by such a hash too.
    Nodes without a community take no part.
    """
    group = [*KB, "community_id"]
    nodes = nodes.where("community_id is not null").select(*group, "canonical_id", "canonical_text", "mention_count")
    w = Window.partitionBy(*KB)
    c = nodes.groupBy(*group).agg(F.count("*").alias("size")).where(F.col("size") >= LEAST_MEMBERS)
    c = c.withColumn("n", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy("community_id"))).where((F.col("n") >= 2) & (F.col("at") <= MOST_COMMUNITIES))
    c = c.withColumn("k", F.least("n", F.lit(MOST_COMMUNITIES)))
    # The intruder's community is another place in the order, drawn by hash.
    step = F.pmod(F.xxhash64(F.lit(seed), "user_id", "kb_id", "community_id"), F.col("k") - 1) + 1
    c = c.withColumn("from_at", F.pmod(F.col("at") - 1 + step, F.col("k")) + 1)
    other = c.select(*KB, F.col("at").alias("from_at"), F.col("size").alias("pool"), F.col("community_id").alias("from_community"))
    pick = (F.pmod(F.xxhash64(F.lit(seed + 1), "community_id", "from_community"), F.col("pool")) + 1).cast("int")
    s = c.join(other, [*KB, "from_at"]).select(*group, "from_community", pick.alias("r"))
    # Members are ranked, and only those shown or drawn are looked up: no row holds a community.
    member = nodes.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("mention_count"), "canonical_id")))
    first = member.where(F.col("r") <= SHOWN).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("r", "canonical_text"))).alias("m"))
    drawn = member.select(*KB, F.col("community_id").alias("from_community"), "r", F.col("canonical_text").alias("intruder"))
    s = s.join(first, group).join(drawn, [*KB, "from_community", "r"])
    items = F.concat(F.col("m.canonical_text"), F.array("intruder"))
    shuffled = F.transform(F.array_sort(F.transform(items, lambda t: F.struct(F.xxhash64(F.lit(seed), t).alias("h"), t.alias("t")))), lambda x: x["t"])
    return s.select(*KB, "community_id", "from_community", shuffled.alias("shown"), "intruder")


def intrusion_score(sets: DataFrame, answers: DataFrame) -> DataFrame:
    """Correct answers of each knowledge base; an empty answer is wrong."""
    j = sets.join(answers, [*KB, "community_id"], "left").withColumn("got", normalized(F.coalesce("answer", F.lit(""))))
    right = (F.col("got") != "") & (F.col("got") == normalized(F.col("intruder")))
    return j.groupBy(*KB).agg(F.count("*").alias("tested"), F.count_if(right).alias("correct")).withColumn("score", F.col("correct") / F.col("tested"))


def resolve_names(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Ground truth rows (``pair_id, filename``) with their document ids; any name without one is an error."""
    j = pairs.join(documents.select("filename", "document_id"), "filename", "left")
    missing = [r.filename for r in j.where("document_id is null").select("filename").distinct().limit(5).collect()]
    if missing:
        raise LookupError(f"no document for {missing}")
    return j


def qa_scores(answers: DataFrame) -> DataFrame:
    """Shares of questions whose documents were all retrieved and whose answer was judged right (``retrieved, correct``)."""
    return answers.agg(F.count("*").alias("questions"), F.avg(F.col("retrieved").cast("int")).alias("retrieval_score"), F.avg(F.col("correct").cast("int")).alias("answer_score"))
