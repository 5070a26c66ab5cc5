"""Chains that connect identities across passages, relation review and alias merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import capitalised
from ..sources.lineage import cut
from .blocks import relation_label
from .model import KB, lift


def proper_edges(e: DataFrame, resolved: DataFrame, canon: DataFrame) -> DataFrame:
    """Distinct canonical pairs whose two names are capitalised."""
    named = canon.where(capitalised(F.col("canonical_text"))).select("canonical_id")
    p = lift(e, resolved).select(*KB, F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    return p.join(named.withColumnRenamed("canonical_id", "a"), "a", "left_semi").join(named.withColumnRenamed("canonical_id", "b"), "b", "left_semi").select(*KB, "a", "b")


def symmetric(p: DataFrame) -> DataFrame:
    return p.select(*KB, "a", "b").union(p.select(*KB, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


#: Nodes of each knowledge base that are looked at first; twice as many in each turn after that. Few, since a node may cost all edges, and most knowledge bases have their pairs by the first ones.
FIRST_NODES = 4


def _next_ring(front: DataFrame, sym: DataFrame, *inner: DataFrame) -> DataFrame:
    """Distinct pairs one edge beyond ``front`` (``user_id, kb_id, a, b``) that are in none of the ``inner`` rings."""
    nxt = sym.select(F.col("a").alias("b"), F.col("b").alias("c"))
    out = front.join(nxt, "b").where("a <> c").select(*KB, "a", F.col("c").alias("b")).distinct()
    for ring in inner:
        out = out.join(ring, ["a", "b"], "left_anti")
    return out


def candidate_pairs(sym: DataFrame, recorded: DataFrame, limit: int = 20) -> DataFrame:
    """Unordered pairs at distance exactly three that aren't recorded yet: the first ``limit`` of each knowledge base.

    The first pairs are those of the first nodes, so rings are drawn around a few nodes of
    each knowledge base at a time, in ascending order, until it has its pairs. A ring holds
    each node once, so a node costs its knowledge base's edges at most, hubs included.
    """
    sym = cut(sym.select(*KB, "a", "b"))
    order = Window.partitionBy(*KB).orderBy("a")
    nodes = cut(sym.select(*KB, "a").distinct().withColumn("turn", F.row_number().over(order)))
    most = nodes.agg(F.max("turn")).first()[0] or 0
    known = recorded.select("a", "b").distinct()
    found, open_, low, width = None, nodes.select(*KB).distinct(), 0, FIRST_NODES
    first = Window.partitionBy(*KB).orderBy("a", "b")
    while low < most or found is None:
        here = nodes.where(F.col("turn").between(low + 1, low + width)).join(open_, KB, "left_semi").select("a")
        one = cut(sym.join(here, "a", "left_semi"))
        two = cut(_next_ring(one, sym, one.select("a", "b")))
        three = _next_ring(two, sym, one.select("a", "b"), two.select("a", "b")).where("a < b").join(known, ["a", "b"], "left_anti")
        three = three.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit).drop("place")
        found = cut(three if found is None else found.unionByName(three))
        done = found.groupBy(*KB).agg(F.count("*").alias("n")).where(F.col("n") >= limit)
        open_ = cut(open_.join(done, KB, "left_anti"))
        low, width = low + width, 2 * width
        if open_.isEmpty():
            break
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit).drop("place").select(*KB, "a", "b")


def candidate_chains(e: DataFrame, resolved: DataFrame, canon: DataFrame, chunks: DataFrame, recorded: DataFrame, limit: int = 20) -> DataFrame:
    """Candidates with one path each (the smallest middle nodes), their first mentions and the passage that bridges the middle."""
    sym = cut(symmetric(proper_edges(e, resolved, canon)))
    pairs = cut(candidate_pairs(sym, recorded, limit))
    hop = lambda x, y: sym.select(F.col("a").alias(x), F.col("b").alias(y))
    # Both ends' neighbours meet over one edge, in place of all paths from one end.
    paths = pairs.join(hop("a", "mid1"), "a").join(hop("mid1", "mid2"), "mid1").join(pairs.select("a", "b").join(hop("b", "mid2"), "b"), ["a", "b", "mid2"])
    chosen = paths.groupBy(*KB, "a", "b").agg(F.min(F.struct("mid1", "mid2")).alias("m")).select(*KB, "a", "b", "m.mid1", "m.mid2")
    middle = lift(e, resolved).select("chunk_id", F.col("a").alias("ea"), F.col("b").alias("eb"), "x", "y")
    bridge = chosen.withColumn("x", F.least("mid1", "mid2")).withColumn("y", F.greatest("mid1", "mid2")).join(middle, ["x", "y"])
    bridge = bridge.groupBy("a", "b").agg(F.min_by("chunk_id", F.struct("ea", "eb")).alias("bridge_chunk"))
    # The representative mention has the canonical id itself, which is the smallest mention id.
    rep = resolved.where("mention_id = canonical_id").select("canonical_id", F.col("text").alias("t"), F.col("chunk_id").alias("c"))
    ra = rep.select(F.col("canonical_id").alias("a"), F.col("t").alias("text_a"), F.col("c").alias("chunk_a"))
    rb = rep.select(F.col("canonical_id").alias("b"), F.col("t").alias("text_b"), F.col("c").alias("chunk_b"))
    out = chosen.join(ra, "a").join(rb, "b").join(bridge, ["a", "b"], "left")
    text = chunks.select(F.col("chunk_id").alias("bridge_chunk"), F.col("text").alias("bridge_text"))
    return out.join(text, "bridge_chunk", "left").select(*KB, "a", "b", "mid1", "mid2", "text_a", "chunk_a", "text_b", "chunk_b", F.coalesce("bridge_text", F.lit("")).alias("bridge_text"))


def apply_links(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert of relations on ordered pairs: the ends are put in order with their provenance, the fresh relation wins."""
    flip = F.col("a") > F.col("b")
    ordered = fresh.select(*KB, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "relation_type", F.when(flip, F.col("chunk_b")).otherwise(F.col("chunk_a")).alias("chunk_a"), F.when(flip, F.col("chunk_a")).otherwise(F.col("chunk_b")).alias("chunk_b"))
    both = existing.select(*ordered.columns).withColumn("age", F.lit(0)).unionByName(ordered.withColumn("age", F.lit(1)))
    return both.groupBy(*KB, "a", "b").agg(F.max_by(F.struct("relation_type", "chunk_a", "chunk_b"), F.struct("age", "relation_type")).alias("z")).select(*KB, "a", "b", "z.*")


def review_chunks(e: DataFrame, chunk_limit: int = 15) -> DataFrame:
    """``user_id, kb_id, chunk_id`` of the first ``chunk_limit`` chunks of each knowledge base with an unreviewed pair."""
    open_ = e.where("relation_type is null").select(*KB, "chunk_id").distinct()
    return open_.withColumn("place", F.row_number().over(Window.partitionBy(*KB).orderBy("chunk_id"))).where(F.col("place") <= chunk_limit).drop("place")


def review_batch(e: DataFrame, resolved: DataFrame, chunk_limit: int = 15, pair_limit: int = 15) -> DataFrame:
    """The pairs to review next: those of the first ``chunk_limit`` chunks of each knowledge base with an unreviewed pair."""
    open_ = e.where("relation_type is null")
    first = review_chunks(e, chunk_limit)
    w = Window.partitionBy("chunk_id").orderBy("a", "b")
    picked = open_.join(first.select("chunk_id"), "chunk_id", "left_semi").withColumn("place", F.row_number().over(w)).where(F.col("place") <= pair_limit)
    name = lambda c: resolved.select(F.col("mention_id").alias(c), F.col("text").alias(f"text_{c}"))
    return picked.join(name("a"), "a").join(name("b"), "b").select(*KB, "chunk_id", "a", "b", "text_a", "text_b")


def apply_verdicts(e: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``e`` with the labels of ``verdicts`` (``chunk_id, a, b, label``) in lower case; an empty label or one that says none, in any case, is ``none``.

    Pairs without a verdict stay as they are, so that an open one is asked again by the next
    :func:`review_batch`; verdicts on pairs that ``e`` lacks, and null ones, are left out. Of
    several verdicts on a pair the least counts, so a rerun gives the same.
    """
    key = ["chunk_id", "a", "b"]
    v = verdicts.where("label is not null").groupBy(*key).agg(F.min(relation_label(F.col("label"))).alias("_label"))
    return e.join(v, key, "left").withColumn("relation_type", F.coalesce("_label", "relation_type")).select(*e.columns)


#: Members of a class of equal names that one task pairs with the members of another class.
MEMBERS = 2048


def alias_pairs(canon: DataFrame) -> DataFrame:
    """Pairs of a type whose token sets hold one another: classes of equal sets are blocked by token and compared, then their members are paired.

    Two classes meet for the rarest token of the smaller one at most, whatever their members;
    the pairs themselves, the square of a class, are made at the end, not dealt again, and a
    large class is dealt to several tasks.
    """
    kind = [*KB, "entity_type"]
    names = F.sort_array(F.array_distinct(F.split("normalized_text", " ")))
    member = cut(canon.where("normalized_text is not null").select(*kind, "canonical_id", F.array_join(names, " ").alias("name")).distinct())
    c = member.groupBy(*kind, "name").agg(F.count("*").alias("size")).withColumn("tokens", F.split("name", " "))
    t = c.select(*kind, "name", "tokens", F.explode("tokens").alias("token"))
    df = t.groupBy(*kind, "token").agg(F.count("*").alias("df"))
    # A subset shares all its tokens, so the smaller side needs its rarest token only.
    rare = t.join(df, [*kind, "token"]).groupBy(*kind, "name").agg(F.min_by("token", F.struct("df", "token")).alias("token"), F.first("tokens").alias("small"))
    other = t.select(*kind, "token", F.col("name").alias("large_name"), F.col("tokens").alias("large"))
    linked = rare.join(other, [*kind, "token"]).where(F.size(F.array_except("small", "large")) == 0).select(*kind, "name", "large_name")
    dealt = member.join(c.select(*kind, "name", F.ceil(F.col("size") / MEMBERS).alias("parts")), [*kind, "name"])
    one = dealt.select(*kind, "name", F.col("canonical_id").alias("x"), F.pmod(F.xxhash64("canonical_id"), "parts").alias("part"))
    parts = c.select(*kind, "name", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / MEMBERS) - 1)).alias("part"))
    two = linked.join(parts, [*kind, "name"]).join(member.select(*kind, F.col("name").alias("large_name"), F.col("canonical_id").alias("y")), [*kind, "large_name"])
    p = one.join(two, [*kind, "name", "part"]).where("x < y or (name <> large_name and x <> y)")
    p = p.select(*kind, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # An id of several names may meet another more than once.
    several = member.groupBy(*kind, "canonical_id").agg(F.count("*").alias("n")).where("n > 1")
    return p if several.isEmpty() else p.distinct()


def linked_parts(pairs: DataFrame) -> DataFrame:
    """``node, part``: the smallest node that pairs (``a, b``) connect each node with.

    Each node takes the least label around it, then its label's own label, so that chains
    are halved in every turn.
    """
    both = cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    alone = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("part")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "part"), "b").groupBy(F.col("a").alias("node")).agg(F.min("part").alias("least"))
        low = label.join(near, "node").select("node", F.col("part").alias("before"), F.least("part", "least").alias("part"))
        up = low.select(F.col("node").alias("part"), F.col("part").alias("above"))
        far = cut(low.join(up, "part", "left").select("node", "before", F.coalesce("above", "part").alias("part")))
        label = far.select("node", "part")
        if far.where("part <> before").isEmpty():
            break
    return label.unionByName(alone.join(label, "node", "left_anti").select("node", F.col("node").alias("part")))


def merge_aliases(canon: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``user_id, kb_id, canonical_id, survivor`` after the accepted pairs are merged one by one.

    In ascending order of id, an identity that still stands is compared with its accepted
    partners; the one with more mentions survives, then the one created first (where `created_at` is there), then the smaller id. One that is merged
    away stops there. The order matters within a component of the accepted pairs only, which
    merges never leave, so each component is one sequential group.
    """
    a = verdicts.where("accepted").select(*KB, "a", "b")
    canon = canon.withColumn("born", F.unix_micros(F.col("created_at").cast("timestamp")) if "created_at" in canon.columns else F.lit(0).cast("long"))
    a = cut(a)
    part = linked_parts(a)
    members = canon.join(a.select(F.explode(F.array("a", "b")).alias("canonical_id")).distinct(), "canonical_id", "left_semi").select(*KB, F.col("canonical_id").alias("a"), F.lit(None).cast("long").alias("b"), "mention_count", "born")
    rows = members.unionByName(a.withColumn("mention_count", F.lit(None).cast("long")).withColumn("born", F.lit(None).cast("long")))
    rows = rows.join(part.select(F.col("node").alias("a"), "part"), "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        count = {int(r.a): int(r.mention_count) for r in pdf[pdf.b.isna()].itertuples()}
        born = {int(r.a): int(r.born) for r in pdf[pdf.b.isna()].itertuples()}
        near: dict[int, list[int]] = {}
        for r in pdf[pdf.b.notna()].itertuples():
            near.setdefault(int(r.a), []).append(int(r.b))
            near.setdefault(int(r.b), []).append(int(r.a))
        into: dict[int, int] = {}
        grown: dict[int, int] = {}
        for x in sorted(count):
            if x in into:
                continue
            # Both sides count as they stood when the turn of x began.
            count = count | grown
            for y in sorted(near.get(x, [])):
                if y in into or y == x:
                    continue
                keep, lose = (x, y) if (-count[x], born[x], x) < (-count[y], born[y], y) else (y, x)
                into[lose] = keep
                grown[keep] = grown.get(keep, count[keep]) + grown.get(lose, count[lose])
                if lose == x:
                    break

        def root(v: int) -> int:
            while v in into:
                v = into[v]
            return v

        ids = sorted(count)
        return pd.DataFrame({"user_id": pdf.user_id.iloc[0], "kb_id": pdf.kb_id.iloc[0], "canonical_id": ids, "survivor": [root(v) for v in ids]})

    return rows.groupBy(*KB, "part").applyInPandas(run, "user_id string, kb_id string, canonical_id long, survivor long")
