"""Association-weighted entity graphs, communities, views and paths."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import KB, lift

LEAST_PAIRS = 2
BOOST, DAMP, RESCUE = 2.0, 0.5, 1.0
VIEW_SHARE, VIEW_CAP = 0.95, 10
COMMUNITY_GUARD = 5000


def pair_counts(e: DataFrame, resolved: DataFrame) -> DataFrame:
    """Canonical pairs of each knowledge base with their counts, relation flags, documents and relation."""
    real = "relation_type is not null and relation_type <> 'none'"
    return lift(e, resolved).groupBy(*KB, F.col("x").alias("a"), F.col("y").alias("b")).agg(
        F.sum("co_occurrence_count").alias("co"), F.coalesce(F.expr(f"bool_or({real})"), F.lit(False)).alias("confirmed"),
        F.coalesce(F.expr("bool_or(relation_type = 'none')"), F.lit(False)).alias("none_found"), F.countDistinct("document_id").alias("document_count"),
        F.expr(f"max(relation_type) filter (where {real})").alias("relation_type"),
    )


def ppmi(co: Column, fa: Column, fb: Column, total: Column) -> Column:
    """Positive pointwise mutual information in bits; 0 under two joint counts or without frequencies."""
    expected = fa.cast("double") * fb.cast("double") / total.cast("double")
    ok = (co >= LEAST_PAIRS) & (fa > 0) & (fb > 0) & (total > 0)
    return F.when(ok, F.greatest(F.lit(0.0), F.log2(co / expected))).otherwise(F.lit(0.0))


def weighted(pairs: DataFrame, canon: DataFrame) -> DataFrame:
    """Adds ``pmi`` to pairs; frequencies and their total are those of the knowledge base."""
    total = canon.groupBy(*KB).agg(F.sum("mention_count").alias("total"))
    fa = canon.select(F.col("canonical_id").alias("a"), F.col("mention_count").alias("fa"))
    fb = canon.select(F.col("canonical_id").alias("b"), F.col("mention_count").alias("fb"))
    p = pairs.join(fa, "a").join(fb, "b").join(total, KB)
    return p.withColumn("pmi", ppmi(F.col("co"), F.col("fa"), F.col("fb"), F.col("total"))).drop("fa", "fb", "total")


def boosted(p: DataFrame) -> DataFrame:
    """Weights after review: confirmed pairs count double, refuted ones half; confirmed pairs without weight come back at 1."""
    factor = F.when(F.col("confirmed"), F.lit(BOOST)).when(F.col("none_found"), F.lit(DAMP)).otherwise(F.lit(1.0))
    return p.where("pmi > 0 or confirmed").withColumn("weight", F.when(F.col("pmi") > 0, F.col("pmi") * factor).otherwise(F.lit(RESCUE)))


def kb_graph(e: DataFrame, resolved: DataFrame, canon: DataFrame) -> DataFrame:
    return boosted(weighted(pair_counts(e, resolved), canon))


def degrees(g: DataFrame) -> DataFrame:
    return g.select(*KB, F.explode(F.array("a", "b")).alias("canonical_id")).groupBy(*KB, "canonical_id").agg(F.count("*").alias("degree"))


def trimmed(nodes: DataFrame) -> DataFrame:
    """The nodes that a display keeps: a community of more than ten keeps its ``ceil(size * (1 - 0.95))`` best by degree, one to ten; nodes without community are a group of their own."""
    w = Window.partitionBy(*KB, "community_id")
    keep = F.least(F.lit(VIEW_CAP), F.greatest(F.lit(1), F.ceil(F.col("m") * F.lit(1 - VIEW_SHARE))))
    n = nodes.withColumn("m", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("degree"), "canonical_id")))
    return n.where((F.col("m") <= VIEW_CAP) | (F.col("r") <= keep)).drop("m", "r")


def view_filter(nodes: DataFrame, g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``canonical_id, community_id, degree``) and edges of the display graph: those :func:`trimmed` keeps; edges need both ends and nodes an edge."""
    kept = trimmed(nodes)
    ids = kept.select("canonical_id")
    e = g.join(ids.withColumnRenamed("canonical_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("canonical_id", "b"), "b", "left_semi")
    final = degrees(e).select("canonical_id")
    return kept.join(final, "canonical_id", "left_semi"), e


def modularity(nodes: DataFrame, g: DataFrame) -> DataFrame:
    """Q of a given assignment: ``sum over communities of (inside / m - (degree / 2m)**2)``; 0 without edges.

    Edges with an end that ``nodes`` lacks take no part. Weights are summed as decimals of
    twelve places, so that the order of rows doesn't show.
    """
    c = nodes.select("canonical_id", "community_id")
    g = g.withColumn("weight", F.col("weight").cast("decimal(24,12)"))
    e = g.join(c.select(F.col("canonical_id").alias("a"), F.col("community_id").alias("ca")), "a").join(c.select(F.col("canonical_id").alias("b"), F.col("community_id").alias("cb")), "b")
    total = e.groupBy(*KB).agg(F.sum("weight").cast("double").alias("m"))
    inside = e.where("ca = cb").groupBy(*KB, F.col("ca").alias("community_id")).agg(F.sum("weight").cast("double").alias("inside"))
    deg = e.select(*KB, "weight", F.explode(F.array("ca", "cb")).alias("community_id")).groupBy(*KB, "community_id").agg(F.sum("weight").cast("double").alias("deg"))
    q = deg.join(inside, [*KB, "community_id"], "left").join(total, KB)
    term = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), F.lit(2))
    total = F.sum(term.cast("decimal(24,15)")).cast("double").alias("modularity")
    return nodes.select(*KB).distinct().join(q.groupBy(*KB).agg(total), KB, "left").na.fill(0.0, ["modularity"])


def louvain_one(nodes: list, links: list[tuple], passes: int = 1000) -> dict:
    """Communities of one graph: nodes and edges in order, moves to the first neighbour community with the largest positive gain."""
    own = {v: i for i, v in enumerate(nodes)}
    adj: list[dict[int, float]] = [{} for _ in nodes]
    self_w = [0.0] * len(nodes)
    for a, b, w in links:
        i, j = own[a], own[b]
        if i == j:
            self_w[i] += w
        else:
            adj[i][j] = adj[i].get(j, 0.0) + w
            adj[j][i] = adj[j].get(i, 0.0) + w
    member = list(range(len(nodes)))
    while True:
        deg = [sum(x.values()) + 2 * s for x, s in zip(adj, self_w, strict=True)]
        two_m = sum(deg)
        com, tot = list(range(len(adj))), deg[:]
        if two_m == 0:
            break
        moved_any = False
        for _ in range(passes):
            moved = False
            for i, near in enumerate(adj):
                old = com[i]
                tot[old] -= deg[i]
                to: dict[int, float] = {}
                for j, w in near.items():
                    to[com[j]] = to.get(com[j], 0.0) + w
                best, gain = old, 0.0  # a move needs a gain of its own
                for c, w in to.items():
                    g = w - tot[c] * deg[i] / two_m
                    if g > gain:
                        best, gain = c, g
                tot[best] += deg[i]
                com[i] = best
                moved |= best != old
            moved_any |= moved
            if not moved:
                break
        if not moved_any:
            break
        code: dict[int, int] = {}
        for c in com:
            code.setdefault(c, len(code))
        up: list[dict[int, float]] = [{} for _ in code]
        new_self = [0.0] * len(code)
        for i, near in enumerate(adj):
            a = code[com[i]]
            new_self[a] += self_w[i]
            for j, w in near.items():
                b = code[com[j]]
                if a == b:
                    new_self[a] += w / 2
                else:
                    up[a][b] = up[a].get(b, 0.0) + w
        member = [code[com[m]] for m in member]
        adj, self_w = up, new_self
    seen: dict[int, int] = {}
    return {v: seen.setdefault(member[i], len(seen)) for i, v in enumerate(nodes)}


def communities(nodes: DataFrame, g: DataFrame, guard: int = COMMUNITY_GUARD) -> DataFrame:
    """``user_id, kb_id, canonical_id, community_id`` by modularity; :func:`community_status` names the knowledge bases above the guard, which have no rows here.

    The method is sequential in a graph, so each knowledge base is one group; the guard
    bounds a group's nodes, and larger ones leave before any data is grouped.
    """
    small = nodes.groupBy(*KB).agg(F.count("*").alias("n")).where(F.col("n") <= guard).select(*KB)
    rows = nodes.join(small, KB, "left_semi").select(*KB, F.col("canonical_id").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("w"))
    rows = rows.unionByName(g.join(small, KB, "left_semi").select(*KB, "a", "b", F.col("weight").alias("w")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf.loc[pdf.b.isna(), "a"].tolist())
        e = pdf[pdf.b.notna()].sort_values(["a", "b"])
        found = louvain_one(ids, [(a, int(b), w) for a, b, w in zip(e.a, e.b, e.w, strict=True)])
        return pd.DataFrame({"user_id": pdf.user_id.iloc[0], "kb_id": pdf.kb_id.iloc[0], "canonical_id": ids, "community_id": [found[i] for i in ids]})

    return rows.groupBy(*KB).applyInPandas(run, "user_id string, kb_id string, canonical_id long, community_id int")


def community_status(nodes: DataFrame, guard: int = COMMUNITY_GUARD) -> DataFrame:
    """``user_id, kb_id, nodes, status`` of every knowledge base: ``too_large`` above the guard, else ``ok``."""
    n = nodes.groupBy(*KB).agg(F.count("*").alias("nodes"))
    return n.withColumn("status", F.when(F.col("nodes") > guard, "too_large").otherwise("ok"))


def shortest_paths(g: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``canonical_id, distance, path`` of the targets that any source reaches; breadth first, one join a hop.

    Each hop meets only nodes not reached before and keeps one parent for each, the smallest;
    it ends when a hop finds none. Paths go from a source to the target and are put together
    backwards, hop by hop, for the targets alone.
    """
    from ..sources.lineage import cut

    both = cut(g.select("a", "b").union(g.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    front = cut(sources.select("canonical_id").distinct().withColumn("distance", F.lit(0)).withColumn("parent", F.lit(None).cast("long")))
    rings = [front]
    seen = front
    for d in count(1):
        step = both.join(front.select(F.col("canonical_id").alias("a")), "a").groupBy(F.col("b").alias("canonical_id")).agg(F.min("a").alias("parent"))
        front = cut(step.join(seen, "canonical_id", "left_anti").select("canonical_id", F.lit(d).alias("distance"), "parent"))
        if front.isEmpty():
            break
        rings.append(front)
        seen = seen.unionByName(front)
    wanted = seen.join(targets.select("canonical_id").distinct(), "canonical_id", "left_semi")
    walk = cut(wanted.select("canonical_id", "distance", F.array("canonical_id").alias("path"), F.col("parent").alias("at")))
    for ring in reversed(rings[:-1]):
        up = ring.select(F.col("canonical_id").alias("at"), F.col("parent").alias("_up"), F.lit(True).alias("_here"))
        walk = walk.join(up, "at", "left").select("canonical_id", "distance", F.when(F.col("_here"), F.concat(F.array("at"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("_here"), F.col("_up")).otherwise(F.col("at")).alias("at"))
    return walk.select("canonical_id", "distance", "path")


def structure(nodes: Column, groups: Column, q: Column) -> Column:
    """How separate the communities of a graph are, in a word."""
    return (
        F.when(nodes == 0, "empty").when(groups <= 1, "single").when(nodes / groups < 1.5, "barely connected")
        .when(q >= 0.4, "well separated").when(q >= 0.15, "loosely related").otherwise("overlapping")
    )
