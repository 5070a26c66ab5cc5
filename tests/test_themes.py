"""Themes: which communities are offered, their members, and the order of a run's themes."""

from graphloom.operators import themes as T

NODES = "user_id string, kb_id string, community_id long, canonical_id long, canonical_text string, mention_count long, size string"


def nodes(spark, sizes, user="u"):
    rows, at = [], 0
    for c, n in sizes.items():
        for i in range(n):
            rows.append((user, "k", c, at, f"n{at}", i % 3, "x"))
            at += 1
    return spark.createDataFrame(rows, NODES)


def test_the_largest_twentieth_is_offered(spark):
    offered = lambda sizes: [(r.community_id, r["size"]) for r in T.top_communities(nodes(spark, sizes)).orderBy("community_id").collect()]
    assert offered({}) == []
    assert offered({None: 4}) == []
    assert offered({1: 2, 2: 2, None: 9}) == [(1, 2)]
    assert offered({c: 1 + (c == 7) for c in range(21)}) == [(0, 1), (7, 2)]
    assert [c for c, _ in offered(dict.fromkeys(range(150), 1))] == [0, 1, 2, 3, 4]


def test_members_are_capped_by_mentions(spark):
    n = nodes(spark, {1: 70, 2: 3})
    got = {r.community_id: r.members for r in T.prompt_members(n, T.community_sizes(n)).collect()}
    want = sorted(range(70), key=lambda i: (-(i % 3), i))[:30]
    assert got[1] == [f"n{i}" for i in want]
    assert got[2] == ["n72", "n71", "n70"]


def test_themes_by_size_and_lost_communities(spark):
    n = nodes(spark, {1: 2, 2: 5, 3: 5})
    t = spark.createDataFrame([("u", "k", c, f"t{c}") for c in (1, 3, 2, 9)], "user_id string, kb_id string, community_id long, label string")
    got = [(r.label, r.entity_count) for r in T.saved_themes(t, n).orderBy("place").collect()]
    assert got == [("t2", 5), ("t3", 5), ("t1", 2), ("t9", 0)]


def test_descriptions(spark):
    two = nodes(spark, {0: 3, 1: 3})
    g = spark.createDataFrame([("u", "k", 0, 1, 1.0), ("u", "k", 1, 2, 1.0), ("u", "k", 3, 4, 1.0), ("u", "k", 4, 5, 1.0)], "user_id string, kb_id string, a long, b long, weight double")
    assert T.described(two, g).first().structure == "well separated"
    assert T.described(two, g).first().modularity == 0.5
    lone = T.described(nodes(spark, {c: 1 for c in range(4)}), g.where("a > 99")).first()
    assert (lone.nodes, lone.communities, lone.modularity, lone.structure) == (4, 4, 0.0, "barely connected")
    none = T.described(nodes(spark, {None: 4}), g).first()
    assert (none.nodes, none.communities, none.structure) == (4, 0, "single")
    assert T.described(nodes(spark, {}), g).count() == 0
