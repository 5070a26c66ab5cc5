import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators.embedding import WIDTH, embed
from graphloom.operators.evaluation import intrusion_score, intrusion_sets
from graphloom.operators.graph import communities, louvain_one, modularity
from graphloom.operators.retrieval import route_of


def _members(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for kb, sizes in {"one": [5], "two": [3, 2, 9], "many": [rng.randrange(3, 8) for _ in range(34)], "none": [2, 2]}.items():
        for c, n in enumerate(sizes):
            for _ in range(n):
                i += 1
                rows.append(("u", kb, i, c, f"Name {i}", rng.randrange(1, 4)))
    return rows


def test_intrusion_sets_by_brute_force(spark):
    rows = _members(1)
    nodes = spark.createDataFrame(rows, "user_id string, kb_id string, canonical_id long, community_id int, canonical_text string, mention_count long")
    got = intrusion_sets(nodes).collect()
    groups = defaultdict(list)
    for _, kb, i, c, text, n in rows:
        groups[kb, c].append((-n, i, text))
    testable = {kb: sorted(c for k, c in groups if k == kb and len(groups[k, c]) >= 3)[:30] for kb in ("one", "two", "many", "none")}
    want = {(kb, c) for kb, cs in testable.items() if len(cs) >= 2 for c in cs}
    assert {(r.kb_id, r.community_id) for r in got} == want
    for r in got:
        own = [t for _, _, t in sorted(groups[r.kb_id, r.community_id])[:4]]
        assert sorted(r.shown) == sorted([*own, r.intruder]) and len(r.shown) == len(own) + 1
        assert r.from_community != r.community_id and r.from_community in testable[r.kb_id]
        assert r.intruder in [t for _, _, t in groups[r.kb_id, r.from_community]]
    # The draw is the same each time, and differs by seed.
    assert sorted(got) == sorted(intrusion_sets(nodes.repartition(5)).collect())
    assert sorted(r.intruder for r in got) != sorted(r.intruder for r in intrusion_sets(nodes, seed=7).collect())
    # The intruder's place isn't told by the order.
    assert len({r.shown.index(r.intruder) for r in got}) > 2


def test_no_row_holds_a_community(spark):
    """Of a community of many members, only those shown or drawn are collected."""
    nodes = spark.range(30_000).selectExpr("'u' as user_id", "'k' as kb_id", "id as canonical_id", "cast(id % 3 as int) as community_id", "concat('Name ', id) as canonical_text", "id % 50 as mention_count")
    nodes = nodes.unionByName(nodes.limit(5).withColumn("community_id", F.lit(None).cast("int")))
    sets = intrusion_sets(nodes)
    got = sets.collect()
    assert sorted(r.community_id for r in got) == [0, 1, 2]
    for r in got:
        most = sorted((i for i in range(r.community_id, 30_000, 3)), key=lambda i: (-(i % 50), i))[:4]
        assert set(r.shown) == {f"Name {i}" for i in most} | {r.intruder} and int(r.intruder[5:]) % 3 == r.from_community
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "WindowGroupLimit" in plan.split("collect_list")[1]


def test_intrusion_scores(spark):
    sets = spark.createDataFrame([("u", "k", 0, "The  Name"), ("u", "k", 1, "Other"), ("u", "k", 2, "Third"), ("u", "k", 3, "Fourth")], "user_id string, kb_id string, community_id int, intruder string")
    answers = spark.createDataFrame([("u", "k", 0, " the name"), ("u", "k", 1, ""), ("u", "k", 2, "wrong")], "user_id string, kb_id string, community_id int, answer string")
    assert [(r.tested, r.correct, r.score) for r in intrusion_score(sets, answers).collect()] == [(4, 1, 0.25)]


def test_embeddings_have_length_one(spark):
    df = spark.createDataFrame([(1, "a few words"), (2, ""), (3, None), (4, "words few a")], "id long, text string").selectExpr("*", "7 as embedding_")
    got = {r.id: np.array(r.embedding) for r in embed(df).collect()}
    assert all(v.shape == (WIDTH,) and abs(np.linalg.norm(v) - 1) < 1e-6 for v in got.values())
    assert (got[1] == got[4]).all() and (got[2] == got[3]).all() and (got[1] != got[2]).any()


def test_communities_are_better_than_any_single_move(spark):
    """Two cliques and a weak bridge; and on random graphs, no node gains by moving to a neighbour's community."""
    rng = random.Random(9)
    for _ in range(5):
        n = 14
        links = [(a, b, rng.choice([0.5, 1.0, 2.0])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25]
        com = louvain_one(list(range(n)), links)
        m = sum(w for *_, w in links)

        def q(c, links=links, m=m):
            inside, deg = defaultdict(float), defaultdict(float)
            for a, b, w in links:
                deg[c[a]] += w
                deg[c[b]] += w
                if c[a] == c[b]:
                    inside[c[a]] += w
            return sum(inside[k] / m - (deg[k] / (2 * m)) ** 2 for k in deg)

        assert q(com) >= q({v: v for v in range(n)}) - 1e-12
        assert q(com) >= q({v: 0 for v in range(n)}) - 1e-12
    clique = [(a, b, 1.0) for g in (0, 4) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(3, 4, 0.1)]
    g = spark.createDataFrame([("u", "k", *x) for x in clique], "user_id string, kb_id string, a long, b long, weight double")
    nodes = spark.createDataFrame([("u", "k", i) for i in range(9)], "user_id string, kb_id string, canonical_id long")
    found = communities(nodes, g)
    by = defaultdict(set)
    for r in found.collect():
        by[r.community_id].add(r.canonical_id)
    assert sorted(map(sorted, by.values())) == [[0, 1, 2, 3], [4, 5, 6, 7], [8]]
    m = 12.1
    assert abs(modularity(found, g).first().modularity - (12 / m - 2 * (12.1 / (2 * m)) ** 2)) < 1e-9


def test_routes(spark):
    assert [route_of(spark, q) for q in ("How many are there?", "What links a and b?", "what is a?")] == ["aggregation", "multi_hop", "normal"]
    from pyspark.sql import functions as F

    assert route_of(spark, "x", lambda q: F.lit("something else")) == "normal"
