import hashlib
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.llm.centroids import cluster, distinct, quantised


def brute(rows, clusters, rounds, width):
    """Lloyd's rounds on all rows in Python's own integers."""
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    cents = [q for _, q in named[:clusters]]
    if not cents:
        return []
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        means = {}
        for k in set(own):
            mine = [q for (_, q), o in zip(kept, own, strict=True) if o == k]
            means[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
        cents = [means.get(k, c) for k, c in enumerate(cents)]
    last = [(i, *near(q)) for i, q in kept]
    total = sum(d for _, d, _ in last)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, k, d, sum(e for _, e, j in last if j == k), total, sha[k]) for i, d, k in last), key=str)


def run(spark, rows, clusters, rounds, width, more=""):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    if more:
        df = df.selectExpr("*", *more.split(";"))
    return sorted((tuple(r) for r in cluster(df, clusters, rounds, width).collect()), key=str)


component = st.one_of(st.sampled_from([0.0, -0.0, 0.5, -0.5, 1 / 256, -1 / 512, 3.25]), st.floats(-4, 4, width=32))


@settings(deadline=None, max_examples=8, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.lists(component, min_size=3, max_size=3)), max_size=25), st.integers(1, 5))
def test_rounds_equal_brute_force(spark, rows, clusters):
    assert run(spark, rows, clusters, 3, 3) == brute(rows, clusters, 3, 3)


def test_nulls_ties_repeated_rows_and_clashing_names(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [5.0, 5.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [0.5, 0.5]), (9, [0.0, 1.0])]
    got = run(spark, rows, 4, 2, 2, more="1 as cluster;2 as q;3 as weight;4 as distance")
    assert got == brute(rows, 4, 2, 2) and len(got) == 6


def test_a_vector_that_most_rows_share(spark):
    rows = [(i, [0.25, -0.75] if i % 3 else [i / 64, 1.0]) for i in range(2000)]
    assert distinct(quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2)).count() < 700
    assert run(spark, rows, 6, 2, 2) == brute(rows, 6, 2, 2)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(400_000.0 + i)), float(-300_000 - 7 * i)]) for i in range(12)]
    assert run(spark, rows, 3, 2, 2) == brute(rows, 3, 2, 2)
    with pytest.raises(Exception, match="beyond the range"):
        run(spark, [(1, [1e9, 0.0])], 1, 1, 2)


def test_empty_tables(spark):
    assert run(spark, [], 3, 2, 2) == [] and run(spark, [(1, None), (2, [1.0])], 3, 2, 2) == []


def test_query_on_the_small_tables(spark, small):
    from graphloom.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_centroid_clusters"](spark, small).collect()), key=str) == brute(rows, 40, 5, 64)
