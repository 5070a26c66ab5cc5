import numpy as np
import pytest

from graphloom.operators import vector_index as V


def brute(vectors, queries, k):
    unit = lambda x: np.array(x, float) / (np.linalg.norm(x) or 1.0)
    out = []
    for q, x in queries:
        s = sorted((-round(float(unit(x) @ unit(v)), 6) + 0.0, i) for i, v in vectors)[:k]
        out += [(q, i, -d + 0.0, n + 1) for n, (d, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 5])
def test_exact_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, np.float32(rng.normal(size=8)).tolist()) for i in range(300)] + [(i, [1.0] + [0.0] * 7) for i in range(300, 360)] + [(360, [0.0] * 8)]
    extra = [(400, None), (401, [1.0])]
    v = spark.createDataFrame(rows + extra, "id long, embedding array<float>").selectExpr("*", "1 as cell", "2 as angle")
    asked = [*((i, x) for i, x in rows if i % 20 == 0), (1000, [0.0] * 8)]
    q = spark.createDataFrame([*asked, (1001, None)], "query_id long, q array<float>")
    index = V.build(v, 8)
    got = sorted((r.query_id, r.id, round(r.score, 6) + 0.0, r.rank) for r in V.search(index, q, 5, probes=2, exact=True).collect())
    assert got == brute(rows, asked, 5)
    assert index[1].selectExpr("sum(size(ids)) as n").first().n == len(rows)


def test_far_cells_are_left_out(spark):
    """Two bundles at a right angle: the bound of the other one is below what is found."""
    rng = np.random.default_rng(1)
    rows = [(i, np.float32(np.array([1.0, 0, 0, 0]) + rng.normal(size=4) / 50).tolist()) for i in range(50)] + [(i, np.float32(np.array([0, 1.0, 0, 0]) + rng.normal(size=4) / 50).tolist()) for i in range(50, 100)]
    table, _ = V.build(spark.createDataFrame(rows, "id long, embedding array<float>"), 4, cells=2)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], 0.9)], "query_id long, q array<float>, least double")
    assert V._probe(q, table.collect(), 1, None, True).count() == 0


def test_empty_index(spark):
    none = V.build(spark.createDataFrame([], "id long, embedding array<float>"), 4)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, q array<float>")
    assert V.search(none, q, 3, exact=True).collect() == []


def test_a_query_is_sent_once_to_a_shelf_of_cells(spark, monkeypatch):
    """Not once to each cell of its turn, whose number grows with the table; a cell of many vectors stands on several shelves."""
    from pyspark.sql import Row

    cells = [Row(cell=i, centre=[float(i + 1), 1.0], radius=3.0, n=100) for i in range(60)] + [Row(cell=60, centre=[-1.0, 0.0], radius=3.0, n=5000)]
    monkeypatch.setattr(V, "SHELF", 2)
    shelves = {s for _, _, s, _ in V._shelves(cells)}
    assert len(shelves) == 3 + 3
    q = spark.createDataFrame([(i, [1.0, float(i)], -2.0) for i in range(40)], "query_id long, q array<double>, least double").coalesce(1)
    sent = V._probe(q, cells, 0, None, True).collect()
    assert sorted(r.shelf for r in sent) == sorted(shelves)
    assert all(sorted(r.query_ids) == list(range(40)) and len(r.flat) == 80 for r in sent)
