import random
from collections import Counter

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import linking as L
from graphloom.operators import retrieval as R
from graphloom.operators.model import KB


def edges_of(spark, rows):
    return spark.createDataFrame([("u", "k", a, b, float(w)) for a, b, w in rows], "user_id string, kb_id string, a long, b long, weight double")


def nodes_of(spark, ids):
    return spark.createDataFrame([("u", "k", i) for i in ids], "user_id string, kb_id string, canonical_id long")


def test_two_triangles(spark):
    g = edges_of(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1), (3, 4, 0.1)])
    c = G.communities(nodes_of(spark, [1, 2, 3, 4, 5, 6, 9]), g)
    by = {r.canonical_id: r.community_id for r in c.collect()}
    assert by[1] == by[2] == by[3] != by[4] == by[5] == by[6] and by[9] not in (by[1], by[4])
    assert G.modularity(c, g).first().modularity > 0.3
    alone = G.communities(nodes_of(spark, [1, 2]), g.limit(0))
    assert {r.community_id for r in alone.collect()} == {0, 1} and G.modularity(alone, g.limit(0)).first().modularity == 0
    assert G.communities(nodes_of(spark, [1, 2, 3]), g, guard=2).count() == 0


def test_ppmi(spark):
    rows = [(1, 5, 5, 1000), (15, 500, 500, 10000), (4, 5, 6, 1000), (400, 500, 500, 1000), (2, 900, 900, 1000), (5, 0, 5, 1000)]
    df = spark.createDataFrame(rows, "co long, fa long, fb long, n long").select(G.ppmi(F.col("co"), F.col("fa"), F.col("fb"), F.col("n")).alias("w"))
    w = [r.w for r in df.collect()]
    assert w[0] == w[1] == w[4] == w[5] == 0 and w[2] > w[3]


def test_boost(spark):
    df = spark.createDataFrame([(1.0, True, True), (1.0, False, True), (1.0, False, False), (0.0, True, False), (0.0, False, True)], "pmi double, confirmed boolean, none_found boolean")
    assert [r.weight for r in G.boosted(df).collect()] == [2.0, 0.5, 1.0, 1.0]


def test_view_keeps_by_float(spark):
    sizes = {10: 10, 11: 1, 19: 1, 20: 2, 40: 3, 200: 10}
    rows = [("u", "k", size * 1000 + i, size, size - i) for size in sizes for i in range(size)] + [("u", "k", 900_000 + i, None, 20 - i) for i in range(11)]
    n = spark.createDataFrame(rows, "user_id string, kb_id string, canonical_id long, community_id int, degree int")
    ids = [r[2] for r in rows]
    hub = edges_of(spark, [(ids[0], i, 1) for i in ids[1:]])
    kept, e = G.view_filter(n, hub)
    got = {r.community_id: r["count"] for r in kept.groupBy("community_id").count().collect()}
    assert got == {**sizes, None: 1}
    assert e.count() == kept.count() - 1


def test_chain_of_three(spark):
    sym = lambda rows: L.symmetric(edges_of(spark, [(a, b, 1) for a, b in rows]))
    none = spark.createDataFrame([], "user_id string, kb_id string, a long, b long")
    pairs = lambda rows, rec=none: [(r.a, r.b) for r in L.candidate_pairs(sym(rows), rec).collect()]
    path = [(1, 2), (2, 3), (3, 4)]
    assert pairs(path) == [(1, 4)]
    assert pairs([*path, (1, 3)]) == [] and pairs([*path, (1, 4)]) == []
    assert pairs(path, spark.createDataFrame([("u", "k", 1, 4)], none.schema)) == []


def test_fusion(spark):
    leg = lambda ids: spark.createDataFrame([("u", "k", i, r + 1) for r, i in enumerate(ids)], "user_id string, kb_id string, chunk_id long, rank int")
    order = lambda legs, k=None: [r.chunk_id for r in R.fuse(legs, k=k).orderBy("rank").collect()]
    assert order([leg([1, 2]), leg([2, 3])]) == [2, 1, 3]
    assert order([leg([5]), leg([4])]) == [4, 5]
    assert order([leg([1, 2]), leg([1, 2])], 1) == [1]
    assert order([leg([1]), leg([])]) == [1]


def test_seed_edges_count_both_ends(spark):
    e = spark.createDataFrame([(7, "u", "k", 1, 2, 1)], "chunk_id long, user_id string, kb_id string, a long, b long, co_occurrence_count int")
    m = spark.createDataFrame([(1, 1, "u", "k"), (2, 2, "u", "k")], "mention_id long, canonical_id long, user_id string, kb_id string")
    c = spark.createDataFrame([(1, "alpha", *("u", "k")), (2, "beta", "u", "k")], "canonical_id long, normalized_text string, user_id string, kb_id string")
    got = R.seed_edges(m, e, R.seeds(c, "alpha or BETA")).groupBy(*KB, "chunk_id").agg(F.sum("co_occurrence_count").alias("w")).collect()
    assert [r.w for r in got] == [2]


def test_alias_merge(spark):
    c = spark.createDataFrame([("u", "k", 1, 3), ("u", "k", 2, 9), ("u", "k", 3, 1)], "user_id string, kb_id string, canonical_id long, mention_count long")
    v = spark.createDataFrame([("u", "k", 1, 2, True), ("u", "k", 2, 3, True), ("u", "k", 1, 3, False)], "user_id string, kb_id string, a long, b long, accepted boolean")
    assert {r.canonical_id: r.survivor for r in L.merge_aliases(c, v).collect()} == {1: 2, 2: 2, 3: 2}


def test_long_paths_and_chains(spark):
    from graphloom.operators.graph import community_status, shortest_paths
    from graphloom.operators.lifecycle import turns

    g = spark.createDataFrame([(i, i + 1) for i in range(14)], "a long, b long")
    one = lambda i: spark.createDataFrame([(i,)], "canonical_id long")
    assert [tuple(r) for r in shortest_paths(g, one(0), one(14)).collect()] == [(14, 14, list(range(15)))]
    chain = [(1, 100, 0, "user", None)] + [(1, 101 + i, 1 + i, "assistant", 100 + i if i else None) for i in range(40)]
    rows = turns(spark.createDataFrame(chain, "conv_id long, message_id long, ordinal long, role string, supersedes long")).collect()
    assert [(r.root, r["query"], r.answers) for r in rows] == [(101, 100, list(range(101, 141)))]
    nodes = spark.createDataFrame([("u", "small", 1)] + [("u", "large", i) for i in range(4)], "user_id string, kb_id string, canonical_id long")
    assert {(r.kb_id, r.nodes, r.status) for r in community_status(nodes, guard=3).collect()} == {("small", 1, "ok"), ("large", 4, "too_large")}


def test_merges_count_as_of_their_turn(spark):
    from graphloom.operators.linking import merge_aliases

    canon = spark.createDataFrame([("u", "k", 1, 3, "2024-01-02"), ("u", "k", 2, 2, "2024-01-01"), ("u", "k", 3, 4, "2024-01-03"), ("u", "k", 5, 7, "2024-01-02"), ("u", "k", 6, 7, "2024-01-01")], "user_id string, kb_id string, canonical_id long, mention_count long, created_at string")
    pairs = spark.createDataFrame([("u", "k", 1, 2, True), ("u", "k", 1, 3, True), ("u", "k", 5, 6, True)], "user_id string, kb_id string, a long, b long, accepted boolean")
    got = {r.canonical_id: r.survivor for r in merge_aliases(canon, pairs).collect()}
    # 1 takes 2 in but still counts 3 in that turn, so 3 survives it; of 5 and 6 the older one does.
    assert got == {1: 3, 2: 3, 3: 3, 5: 6, 6: 6}
    assert {r.canonical_id: r.survivor for r in merge_aliases(canon.drop("created_at"), pairs).collect()}[6] == 5


def test_block_search_by_brute_force(spark):
    import numpy as np

    from graphloom.operators.retrieval import batch_top_k

    x = np.random.default_rng(3).normal(size=(60, 5))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 7 = 0").selectExpr("vec_id as query_id", "embedding as q")
    got = {}
    for r in batch_top_k(v, q, 4, block=3).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {i: set(np.argsort(-(unit @ unit[i]))[:4].tolist()) for i in range(0, 60, 7)}


def test_a_hub_of_ten_thousand_and_rings_by_brute_force(spark, monkeypatch):
    import random

    from graphloom.operators import linking

    monkeypatch.setattr(linking, "FIRST_NODES", 2)
    rng = random.Random(5)
    edges_ = {(min(x, y), max(x, y)) for x, y in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if x != y}
    near = {}
    for x, y in edges_:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    want = []
    for x in sorted(near):
        rings, seen = [{x}], {x}
        for _ in range(3):
            rings.append({z for y in rings[-1] for z in near[y]} - seen)
            seen |= rings[-1]
        want += [(x, z) for z in sorted(rings[3]) if z > x]
    recorded = want[2:3]
    want = [w for w in want if w not in recorded][:20]
    hub = [(1000, 1001 + i) for i in range(10_000)] + [(1001, 999), (999, 998)]
    rows = [("u", "k", a, b) for a, b in edges_] + [("u", "hub", a, b) for a, b in hub]
    sym = linking.symmetric(spark.createDataFrame(rows, "user_id string, kb_id string, a long, b long"))
    known = spark.createDataFrame([("u", "k", a, b) for a, b in recorded], "user_id string, kb_id string, a long, b long")
    got = linking.candidate_pairs(sym, known).collect()
    assert sorted((r.a, r.b) for r in got if r.kb_id == "k") == want
    assert sorted((r.a, r.b) for r in got if r.kb_id == "hub") == [(998, 1000)] + [(999, 1002 + i) for i in range(19)]


def test_parts_of_chains_and_loops(spark):
    from graphloom.operators.linking import linked_parts

    pairs = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.part for r in linked_parts(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_paths_go_from_a_source_to_each_target(spark):
    from graphloom.operators.graph import shortest_paths

    g = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (8, 9)], "a long, b long")
    node = lambda *x: spark.createDataFrame([(i,) for i in x], "canonical_id long")
    got = {r.canonical_id: (r.distance, r.path) for r in shortest_paths(g, node(1), node(1, 3, 5, 9)).collect()}
    assert got == {1: (0, [1]), 3: (2, [1, 2, 3]), 5: (3, [1, 2, 3, 5])}
    assert shortest_paths(g, node(), node(1)).collect() == []


def test_verdicts_move_the_review_on(spark):
    from graphloom.operators.linking import apply_verdicts

    e = spark.createDataFrame([(1, 1, 2, None, "x"), (1, 1, 3, None, "y"), (2, 5, 6, "old", "z"), (2, 5, 7, None, "w")], "chunk_id long, a long, b long, relation_type string, label string")
    v = spark.createDataFrame([(1, 1, 2, "Owns"), (1, 1, 2, "Parts"), (1, 1, 3, " NONE "), (2, 5, 7, None), (9, 9, 9, "lost")], "chunk_id long, a long, b long, label string")
    got = {(r.chunk_id, r.a, r.b): (r.relation_type, r.label) for r in apply_verdicts(e, v).collect()}
    assert got == {(1, 1, 2): ("owns", "x"), (1, 1, 3): ("none", "y"), (2, 5, 6): ("old", "z"), (2, 5, 7): (None, "w")}
    assert apply_verdicts(e, v.limit(0)).count() == 4


def test_batch_search_compares_blocks(spark):
    # One product of matrices a pair of blocks; zero, null, ragged and NaN vectors score as pair by pair.
    v = spark.createDataFrame([(i, [float(i % 5 - 2), float(i % 3), 1.0]) for i in range(40)] + [(50, None), (51, [0.0, 0.0, 0.0]), (52, [1.0]), (53, [1.0, None, 2.0]), (54, []), (55, [float("nan"), 1.0, 1.0])], "vec_id long, embedding array<float>")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = R.batch_top_k(v, q, 7, block=9)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    pairs = q.crossJoin(v).select("query_id", "vec_id", F.round(R.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    slow = R.ranked(pairs, [F.desc("score"), "vec_id"], by=["query_id"], k=7).drop("rank")
    key = lambda df: sorted((r.query_id, r.vec_id, repr(r.score)) for r in df.collect())
    assert key(found) == key(slow)


def test_alias_pairs_of_equal_names_are_made_from_classes(spark, monkeypatch):
    monkeypatch.setattr(L, "MEMBERS", 3)
    words = ["red ring", "ring red", "ring", "red ring big", "bolt", "bolt bolt", "red", None, ""]
    rows = [("u", "k" if i % 7 else "l", i, words[i % 9], "t" if i % 11 else "s", 1) for i in range(90)] + [("u", "k", 2, "bolt", "t", 1)]
    canon = spark.createDataFrame(rows, "user_id string, kb_id string, canonical_id long, normalized_text string, entity_type string, mention_count long")
    slow = set()
    for r in rows:
        for s in rows:
            if r[1] == s[1] and r[4] == s[4] and r[2] < s[2] and r[3] is not None and s[3] is not None:
                x, y = set(r[3].split(" ")), set(s[3].split(" "))
                if x <= y or y <= x:
                    slow.add((r[1], r[4], r[2], s[2]))
    got = [(r.kb_id, r.entity_type, r.a, r.b) for r in L.alias_pairs(canon).collect()]
    assert len(got) == len(set(got)) and set(got) == slow
    # Members of equal names meet at the end only: no aggregate lies above the pairs.
    plain = L.alias_pairs(canon.where("canonical_id <> 2"))
    assert "Aggregate" not in plain._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_review_chunks_need_no_names(spark, small):
    """They are those of the review batch, without its joins to mentions and identities."""
    from graphloom.plans.graph_queries import QUERIES

    chunks = QUERIES["K07_review_chunks"](spark, small)
    assert "canonical_id" not in chunks._jdf.queryExecution().analyzed().toString()
    assert sorted(chunks.collect()) == sorted(QUERIES["J12_review_candidates"](spark, small).select("user_id", "kb_id", "chunk_id").distinct().collect())


def test_rings_begin_around_few_nodes(spark, monkeypatch):
    """A node may cost all edges of its knowledge base, so no more nodes are looked at than the pairs need, or twice as many."""
    from graphloom.operators import linking

    looked, ring = [], linking._next_ring
    monkeypatch.setattr(linking, "_next_ring", lambda front, sym, *inner: (looked.append(front.select("a").distinct().count()), ring(front, sym, *inner))[1])
    p = spark.createDataFrame([("u", "k", i, i + 1) for i in range(200)], "user_id string, kb_id string, a long, b long")
    none = spark.createDataFrame([], "a long, b long")
    got = linking.candidate_pairs(linking.symmetric(p), none, limit=3)
    assert sorted((r.a, r.b) for r in got.collect()) == [(0, 3), (1, 4), (2, 5)]
    assert max(looked) <= 4


def test_two_hops_by_brute_force(spark, small):
    """Windows two hops away, on random windows; the edges are dealt by their ends once, when the seeds' edges are written."""
    rng = random.Random(3)
    rows = [(100 * c + i, c, rng.randrange(25)) for c in range(60) for i in range(rng.randrange(1, 5))]
    resolved = spark.createDataFrame([(m, c, "u", "k", x) for m, c, x in rows], "mention_id long, chunk_id long, user_id string, kb_id string, canonical_id long")
    pairs = [(c, a, b) for a, c, _ in rows for b, d, _ in rows if c == d and a < b and rng.random() < 0.7]
    e = spark.createDataFrame([(c, "u", "k", a, b, 1) for c, a, b in pairs], "chunk_id long, user_id string, kb_id string, a long, b long, co_occurrence_count int")
    of = {m: x for m, _, x in rows}
    for seeds in ([0], [3, 4], [99]):
        touch = [(c, y) for c, a, b in pairs for x, y in ((a, b), (b, a)) if of[x] in seeds]
        near = {of[y] for _, y in touch}
        want = {c for c, a, b in pairs if of[a] in near or of[b] in near} - {c for c, _ in touch}
        got = [r.chunk_id for r in R.two_hops(resolved, e, spark.createDataFrame([(x,) for x in seeds], "canonical_id long")).collect()]
        assert sorted(got) == sorted(want)
    from graphloom.plans.registry import QUERIES

    plan = QUERIES["J05_without_seed_chunks"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(array(") == 1


def test_two_hop_meets_blocks_by_brute_force(spark, monkeypatch):
    from graphloom.operators import hops

    r = random.Random(7)
    rows = {("u", "k", min(r.randrange(90), r.randrange(90)), r.randrange(90)) for _ in range(500)} | {("u", None, r.randrange(200, 230), r.randrange(200, 230)) for _ in range(60)}
    # An id in two knowledge bases leads on to its neighbours in both.
    rows |= {("u", "other", 5, 1 << 62), ("u", "other", -(1 << 62), 5), ("v", "pair", -9, -8)}
    sym = L.symmetric(spark.createDataFrame(sorted(rows, key=str), "user_id string, kb_id string, a long, b long"))
    edges = [tuple(x) for x in sym.collect()]
    near = {}
    for _, _, a, b in edges:
        near.setdefault(a, set()).add(b)
    want = {(u, k, a, c) for u, k, a, b in edges for c in near[b] if c != a}
    # One block; several, a few starts at a time; all rows as bits, and none.
    for block, room, sparse in ((1 << 20, 1 << 22, 128), (100, 512, 8), (100, 1 << 12, 1 << 20), (30, 1, 0)):
        monkeypatch.setattr(hops, "BLOCK_EDGES", block)
        monkeypatch.setattr(hops, "ROOM", room)
        monkeypatch.setattr(hops, "SPARSE", sparse)
        pairs = [tuple(x) for x in hops.two_hop(sym).collect()]
        assert len(pairs) == len(want) and set(pairs) == want
        got = {(x.user_id, x.kb_id, x.a): x.n for x in hops.two_hop_counts(sym).collect()}
        assert got == Counter(x[:3] for x in want)


def test_pairs_around_a_hub_are_counted_without_a_row_each(spark, monkeypatch):
    from graphloom.plans import graph_queries

    star = L.symmetric(spark.createDataFrame([("u", "k", 0, 1_000_000_000_000_000_000 + i) for i in range(2000)], "user_id string, kb_id string, a long, b long"))
    monkeypatch.setitem(graph_queries.QUERIES, "U01_symmetric_closure", lambda spark, d: star)
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def sent() -> int:
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = sent()
    (got,) = graph_queries.QUERIES["J07_two_hop"](spark, "").collect()
    assert (got.n, got.s) == (2000 * 1999, sum(1_000_000_000_000_000_000 + i for i in range(2000)) * 1999)
    # The paths are two thousand times as many as the edges.
    assert sent() - before < 40 * 4000
