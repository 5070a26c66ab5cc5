import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm.queries import op1_quality_resampling
from graphloom.llm.quality import gumbel_top_k, log_weights, models


def test_keeps_exactly_the_largest_keys(spark, small):
    rows = op1_quality_resampling(spark, small).collect()
    keys = sorted((r.gumbel_key for r in rows), reverse=True)
    k = math.ceil(0.5 * len(rows))
    assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in rows if r.gumbel_key >= keys[k - 1]}
    assert sum(r.kept for r in rows) == k


def test_selection_with_signs_and_ties(spark):
    values = [-5.0, -1.0, -1.0, 0.0, 3.5, 1e9, -1e9, 2.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, log_weight double")
    for f in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = gumbel_top_k(df, f, seed=4).collect()
        top = sorted((r.gumbel_key for r in got), reverse=True)[: math.ceil(f * len(values))]
        assert sorted((r.gumbel_key for r in got if r.kept), reverse=True) == top
    assert gumbel_top_k(df.limit(0)).count() == 0


def test_target_like_texts_weigh_more(spark):
    docs = [(i, "the river runs to the sea " * 3) for i in range(20)] + [(100 + i, "zq xv kk jj qq " * 3) for i in range(20)] + [(200, None), (201, ""), (None, "the river"), (0, "the river runs to the sea")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("good", F.lit("clash")).withColumn("bucket", F.lit(1))
    ratio = models(docs, spark.createDataFrame([(i,) for i in range(5)], "doc_id long"))
    rows = log_weights(docs, ratio).collect()
    assert len(rows) == 44
    by = {r.doc_id: r for r in rows}
    assert by[7].log_weight > 0 > by[105].log_weight
    assert by[200].n_features == 0 == by[200].log_weight == by[201].log_weight


M64 = (1 << 64) - 1


def scrambled(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & M64
    return x ^ x >> 31


def buckets(text):
    """Of words of up to eight letters, and of pairs of them."""
    names = [scrambled(int.from_bytes(w.encode(), "little")) for w in re.findall("[a-z0-9]+", text.lower())]
    return [n % 10_000 for n in names] + [scrambled((a * 0xD6E8FEB86659FD93 + b) & M64) % 10_000 for a, b in zip(names, names[1:], strict=False)]


def test_models_weights_and_choice_by_brute_force(spark):
    r = random.Random(2)
    words = ["river", "sea", "to", "the", "runs", "zq", "xv", "kk", "Jumps", "a1"]
    texts = {i: " ".join(r.choice(words[: 6 + i % 5]) for _ in range(r.randrange(0, 30))) for i in range(40)}
    good = {1, 2, 5, 11, 39}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ratio = models(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"))
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(buckets(t))
        if i in good:
            target.update(buckets(t))
    p = np.array([1 + raw[b] for b in range(10_000)], float)
    p /= p.sum()
    q = (np.array([target[b] for b in range(10_000)]) + 1000 * p) / (sum(target.values()) + 1000)
    assert np.allclose(ratio, np.log(q) - np.log(p))
    rows = {x.doc_id: x for x in log_weights(docs, ratio).collect()}
    for i, t in texts.items():
        want = sum(math.log(q[b] / p[b]) for b in buckets(t))
        assert rows[i].n_features == len(buckets(t)) and math.isclose(rows[i].log_weight, want, abs_tol=1e-9)
    even = {x.doc_id: x.log_weight for x in log_weights(docs, ratio, length=100.0).collect()}
    assert all(math.isclose(even[i], 100 * rows[i].log_weight / max(1, rows[i].n_features), abs_tol=1e-9) for i in texts)


def test_repeated_rows_keep_exactly_k(spark):
    df = spark.createDataFrame([(1, 0.0)] * 4 + [(2, -50.0)] * 3 + [(3, 50.0)], "doc_id long, log_weight double").withColumn("kept", F.lit("clash"))
    for f, k in ((0.25, 2), (0.5, 4), (0.75, 6), (1.0, 8)):
        got = gumbel_top_k(df, f, seed=1).collect()
        keys = sorted((r.gumbel_key for r in got), reverse=True)
        assert sum(r.kept for r in got) == k and sorted((r.gumbel_key for r in got if r.kept), reverse=True) == keys[:k]
