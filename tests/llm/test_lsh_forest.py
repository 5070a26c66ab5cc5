import random
import re

from pyspark.sql import functions as F

from graphloom.llm import lsh_forest
from graphloom.llm.lsh_forest import DEPTH, RECALL, near_duplicates, stop_depth


def shingles(text):
    ws = re.findall(r"\w+", (text or "").lower())
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows, threshold):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    sets = [(d, s) for d, s in sets if s]
    links, near = {}, {}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            both = len(x & y)
            if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                links[a] = links.get(a, 0) + 1
                links[b] = links.get(b, 0) + 1
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
    comp = {}
    for v in sorted(near):
        todo = [v]
        while todo:
            u = todo.pop()
            if u not in comp:
                comp[u] = v
                todo += near[u]
    return links, comp


def sample():
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(25):
        base = [r.choice(vocab) for _ in range(r.randrange(3, 150))]
        for i in range(8):
            ws = base[:]
            for _ in range(r.randrange(0, 4)):
                ws[r.randrange(len(ws))] = r.choice(vocab)
            rows.append((g * 50 + i, " ".join(ws)))
    rows += [(3000 + i, rows[0][1]) for i in range(6)] + [(4000, None), (4001, ""), (4002, "..."), (4003, "one two"), (4004, "One, two!"), (None, rows[0][1])]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("rep", F.lit(0))
    links, comp = brute(rows, 0.8)
    assert sum(links.values()) > 100
    for block in (400, 3):
        monkeypatch.setattr(lsh_forest, "BLOCK", block)
        got = near_duplicates(docs, 0.8).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.n_links == links.get(r.doc_id, 0), r
            assert r.component_id == comp.get(r.doc_id, r.doc_id), r
            assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_depth_and_recall():
    assert stop_depth(0.8) >= 2
    assert stop_depth(0.95) >= stop_depth(0.8) >= stop_depth(0.5)
    # Pairs far above the threshold are all found at full depth, those near it aren't.
    assert lsh_forest.estimated_recall({990: 1000}, DEPTH) > 0.9999 > lsh_forest.estimated_recall({800: 1000}, DEPTH)
    assert lsh_forest.estimated_recall({800: 1000}, stop_depth(0.8)) >= RECALL
    assert lsh_forest.estimated_recall({}, DEPTH) == 1


def test_tries_by_brute_force(spark):
    """``deep`` is the longest prefix that an entry shares with any other of its trie."""
    import numpy as np

    r = np.random.default_rng(7)
    v = r.integers(0, 3, (60, lsh_forest.TREES, DEPTH)).astype(np.uint64)
    words = np.zeros((60, lsh_forest.TREES, 2), np.uint64)
    for d in range(DEPTH):
        words[:, :, d // 4] |= (v[:, :, d] + np.uint64(65533)) << np.uint64(16 * (3 - d % 4))
    rows = [(i, 5, words[i].ravel().view(np.int64).tolist()) for i in range(60)]
    got = {(x.tree, x.cls): x.deep for x in lsh_forest.tries(spark.createDataFrame(rows, "k1 long, n int, labels array<long>"), 4).collect()}
    share = lambda a, b: next((d for d in range(DEPTH) if a[d] != b[d]), DEPTH)
    want = {(t, i): max(share(v[i, t], v[j, t]) for j in range(60) if j != i) for t in range(lsh_forest.TREES) for i in range(60)}
    assert got == {k: d for k, d in want.items() if d >= 4} and len(got) > 50


def test_levels_meet_every_pair_once(spark, monkeypatch):
    """All levels together link the same pairs as the last one alone would."""
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links, _ = brute(rows, 0.8)
    monkeypatch.setattr(lsh_forest, "LEAST_RECALL", 2.0)  # go down to the last level
    assert {r.doc_id: r.n_links for r in near_duplicates(docs).collect() if r.n_links} == links


def test_texts_of_one_id(spark):
    """Two texts under one id keep their links apart; unlike words whose polynomial hashes agree differ."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(5, a), (5, b), (5, b), (6, a), (7, b + " more"), (8, f"{word} x"), (9, f"{other} x"), (10, a), (10, a)]
    got = sorted((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 36, 2, 5), (5, 36, 2, 5), (5, 36, 3, 5), (6, 36, 3, 5), (7, 37, 2, 5), (8, 1, 0, 8), (9, 1, 0, 9), (10, 36, 3, 5), (10, 36, 3, 5)]
