import numpy as np

from graphloom.llm.embedding_dedup import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def brute(rows, threshold):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, near = {}, {}
    for i, a in enumerate(ok):
        for b in ok[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a[0]] = links.get(a[0], 0) + 1
                    links[b[0]] = links.get(b[0], 0) + 1
                    near.setdefault(a[0], set()).add(b[0])
                    near.setdefault(b[0], set()).add(a[0])
    comp = {}
    for v in sorted(near):
        if v not in comp:
            todo = [v]
            while todo:
                u = todo.pop()
                if u not in comp:
                    comp[u] = v
                    todo += near[u]
    return links, comp


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        centre = rng.normal(size=8)
        rows += [(g * 100 + i, (centre + rng.normal(size=8) * rng.choice([0.05, 0.25, 0.6])).astype(np.float32).tolist(), g % 2, "x") for i in range(15)]
    rows += [(5000 + i, rows[0][1], 0, "copy") for i in range(9)]
    rows += [(6000, None, 0, None), (6001, [0.0] * 8, 0, None), (6002, [float("nan")] + [1.0] * 7, 0, None), (6003, [None] + [1.0] * 7, 1, None), (6004, rows[0][1], None, None), (6005, [], 0, None), (6006, [1.0, 2.0], 0, None), (6007, [float("inf")] * 8, 0, None)]
    links, comp = brute(rows, 0.93)
    for tile in (1024, 7):
        got = near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.93, tile=tile, lead=3).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.n_links == links.get(r.vec_id, 0), r
            assert r.component_id == comp.get(r.vec_id, r.vec_id), r
            assert r.kept == (r.component_id == r.vec_id)


def test_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, [1.0, 0.0], 1, "")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(None, 0, None, None)]


def test_extreme_lengths_and_shared_ids(spark):
    rows = [(1, [1e200, 1e200], 0, ""), (2, [1e200, 1.1e200], 0, ""), (3, [1e-200, 1e-200], 0, ""), (4, [1e-200, -1e-200], 0, ""), (5, [1e-320, -1.0e-320], 0, "")]
    rows += [(6, [1.0, 0.0], 1, ""), (6, [0.0, 1.0], 1, ""), (7, [1.0, 0.01], 1, ""), (8, [0.01, 1.0], 1, "")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")
    got = sorted(tuple(r) for r in near_duplicates(docs, 0.93).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 6, False)]
    one = spark.createDataFrame([(1, [1e-200, 1e-200], 0, "")], "vec_id long, embedding array<double>, label int, rep string")
    assert [tuple(r) for r in near_duplicates(one).collect()] == [(1, 0, 1, True)]
