import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm.decontaminate import budget
from graphloom.llm.packing import CAPACITY
from tests.llm.test_decontaminate import slow_best
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_lsh_forest import brute as brute_near
from tests.llm.test_packing import whole


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Small documents of the table, with its labels and benchmark, and cases of every stage."""
    d = tmp_path_factory.mktemp("sf")
    src = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{src}/documents.parquet").where("n_chars between 100 and 500").orderBy("doc_id").limit(300)
    item = spark.read.parquet(f"{src}/benchmark.parquet").orderBy("item_id").first().text
    base = docs.first()
    more = [(900_000, base.text, "en", "s", len(base.text)), (900_001, "so " + base.text, "en", "s", 3 + len(base.text)), (900_002, f"before {item} after", "en", "s", 9), (900_003, None, "en", "s", 0), (900_004, "", "en", "s", 0), (900_005, "idiot scum loser moron trash pathetic worthless clown", "en", "s", 50)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    labelled = spark.read.parquet(f"{src}/documents.parquet").join(spark.read.parquet(f"{src}/labels.parquet"), "doc_id").where("toxic = 1 and n_chars < 3000 and lang = 'en'").select(*docs.columns)
    docs = docs.unionByName(labelled.orderBy("doc_id").limit(60)).dropDuplicates(["doc_id"])
    docs.coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{src}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    spark.read.parquet(f"{src}/benchmark.parquet").orderBy("item_id").limit(30).write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_every_stage_by_brute_force(spark, cut):
    docs = spark.read.parquet(f"{cut}/documents.parquet")
    columns, kinds = docs.columns, docs.dtypes
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, cut)
        assert out.dtypes == kinds, name
        rows = out.collect()
        seen.append((name, docs.collect(), rows))
        docs = spark.createDataFrame(rows, docs.schema)
    (_, a, b), (_, b2, c), (_, c2, d), (_, d2, e) = seen
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{cut}/labels.parquet").collect()}
    gone = {r.doc_id for r in a} - {r.doc_id for r in b}
    assert 900_005 in gone and len(gone) > 20 and sum(labels.get(i) == 0 for i in gone) <= 2
    want = {i: w[0] for i, w in brute_lines([(r.doc_id, r.text) for r in b2], short=True).items() if not w[1] or (w[0] or "").strip()}
    assert {r.doc_id: r.text for r in c} == want
    _, comp = brute_near([(r.doc_id, r.text) for r in c2], 0.8)
    assert {r.doc_id for r in d} == {r.doc_id for r in c2 if comp.get(r.doc_id, r.doc_id) == r.doc_id}
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{cut}/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in d2 if any(len(p) >= 4 and slow_best(p, re.findall(r"[^\W_]+", (r.text or "").lower())) <= budget(len(p)) for p in items)}
    assert leaky and {r.doc_id for r in e} == {r.doc_id for r in d2} - leaky
    packed = corpus_pipeline.run(spark, cut).collect()
    lengths = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {r.doc_id: len(whole(r.text)) for r in e}
    full = np.bincount(np.unique([r.sequence_id for r in packed], return_inverse=True)[1], weights=[r.length for r in packed])
    assert full.max() <= CAPACITY
    assert set(columns) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_empty_documents(spark, cut, tmp_path):
    docs = spark.read.parquet(f"{cut}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{cut}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert docs.where(F.lit(False)).count() == 0


def test_copies_leave_no_residue(spark):
    long = ["the first of the lines is long enough to be joined", "another one with quite different words follows here"]
    text = f"{long[0]}\nshort\n\n{long[1]}\n  "
    rows = [(1, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (3, "short", "en", "s", 5), (4, "short\nnew", "en", "s", 9), (5, "", "en", "s", 0), (6, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {1: (text, len(text)), 4: ("new", 3), 5: ("", 0), 6: (None, 0)}


def test_columns_with_the_operators_names(spark, cut):
    docs = spark.read.parquet(f"{cut}/documents.parquet").limit(40)
    for name in ("toxic_score", "n_repeats", "kept_text", "n_shingles", "item_id", "column_2", "doc"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, cut)
        assert out.dtypes == docs.dtypes, name
        assert out.where("toxic_score = 'clash' and n_repeats = 'clash' and doc = 'clash'").count() == out.count() > 0


def test_texts_that_share_an_id_are_told_apart(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    a, b, item = " ".join(words), " ".join(reversed(words)), " ".join(f"q{i}" for i in range(20))
    rows = [(1, a), (2, a + " tail"), (2, b), (3, item), (3, "clean text of its own"), (None, a + " end"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _key", "2 as component_id")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert {(r.doc_id, r.text) for r in near.collect()} == {(1, a), (2, b), (3, item), (3, "clean text of its own"), (4, None)}
    left = corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert {(r.doc_id, r.text) for r in left.collect()} == {(i, t) for i, t in rows if t != item}
