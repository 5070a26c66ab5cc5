import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm.kernels import BYTE_VALUE
from graphloom.llm.queries import op10_toxicity
from graphloom.llm.toxicity import _Distinct, annotate, classify, fit, log_count_ratio, score, train


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op10_toxicity(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert len(rows) > 500
    # Nearly half of the toxic labels of this table are on texts without any sign of it; none of the clean ones may be accused.
    accused = sum(r.predicted > r.toxic for r in rows)
    missed = sum(r.predicted < r.toxic for r in rows)
    assert accused <= 0.005 * len(rows) and missed <= 0.06 * len(rows)
    assert missed <= 0.5 * sum(r.toxic for r in rows)


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, "a"), (2, 0, "a"), (3, None, "a"), (None, 1, "a"), (9, 1, "gone")], "doc_id long, toxic int, text string")
    docs = spark.createDataFrame([(1, "vile vile thing"), (2, "a fine day"), (3, None), (4, ""), (4, ""), (None, "vile")], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    got = classify(docs, train(docs, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] > by[2]
    assert classify(docs.limit(0), train(docs, labels)).count() == 0
    none = train(docs, labels.limit(0))
    assert len({r.score for r in classify(docs, none).collect()}) == 1


def test_one_class_gives_the_prior():
    m = fit([np.array([1]), np.array([2])], np.array([1, 1]), 0.25)
    assert abs(1 / (1 + np.exp(-m.bias)) - 0.25) < 1e-9


def distinct_buckets(text):
    raw, out = text.lower().encode(), set()
    for n in (3, 4, 5):
        for i in range(len(raw) - n + 1):
            g = 0
            for b in raw[i : i + n]:
                g = (g * 0xD6E8FEB86659FD93 + int(BYTE_VALUE[b])) & ((1 << 64) - 1)
            out.add((((g ^ g >> 29) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)) >> 46)
    return out


def test_features_ratios_and_scores_by_brute_force():
    texts = ["Vile, vile thing", "you utter scum", "a fine day", "the river runs", "é", "", "fine scum"]
    y = np.array([1, 1, 0, 0, 0, 1, 0])
    rows = list(_Distinct().rows(pa.array(texts)))
    sets = [distinct_buckets(t) for t in texts]
    assert [set(r.tolist()) for r in rows] == sets and [len(r) for r in rows] == [len(s) for s in sets]
    ratio = log_count_ratio(np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), y.astype(float))
    for b in set().union(*sets):
        pos, neg = (sum(b in s for s, label in zip(sets, y, strict=True) if label == c) for c in (1, 0))
        assert np.isclose(ratio[b], np.log((pos + 1) / (3 + 2)) - np.log((neg + 1) / (4 + 2)))
    model = fit(rows, y, 0.5)
    # A score is the sum over the distinct buckets.
    want = [1 / (1 + np.exp(-(sum(model.weights[b] for b in s) + model.bias))) for s in sets]
    assert np.allclose(score(pa.array(texts), model), want)
    assert want[0] > 0.5 > want[2]


def test_clash_and_repeated_labels(spark):
    docs = spark.createDataFrame([(1, "vile vile thing", 7), (1, "other", 7), (2, "a fine day", 8)], "doc_id long, text string, toxic_score int")
    labels = spark.createDataFrame([(1, 1)] * 5 + [(2, 0)] * 3, "doc_id long, toxic int")
    got = annotate(docs, train(docs, labels)).collect()
    assert len(got) == 3 and all(0 < r.toxic_score < 1 for r in got)


def test_the_fit_holds_no_wide_copy_of_all_features():
    import tracemalloc

    from graphloom.llm import toxicity

    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 1 << toxicity.BITS, 20_000, dtype=np.int32) for _ in range(200)]
    size = sum(r.nbytes for r in rows)
    tracemalloc.start()
    toxicity.fit(rows, np.arange(200) % 2, 0.5, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Three arrays of four bytes a feature, some tables of 2**18 doubles and a block's temporaries.
    assert peak < 5 * size
