import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions.text import content_type, normalized
from graphloom.operators.model import Model, canonical, edges, mentions, resolve, window_mentions, windows
from graphloom.sources.tables import TenantScope, insert_new, replace_documents

DOC = "document_id long, user_id string, kb_id string, text string"


def slow_windows(text, size, overlap):
    d, out, s = text.encode(), [], 0
    start = lambda i: i >= len(d) or d[i] & 0xC0 != 0x80
    back = lambda i: next(j for j in range(i, -1, -1) if start(j))
    onward = lambda i: next(j for j in range(i, len(d) + 1) if start(j))
    place = lambda i: back(i) if back(i) > s else onward(i)
    while s < len(d):
        e = len(d) if s + size >= len(d) else place(s + size)
        out.append((s, e))
        if e == len(d):
            break
        s = place(s + max(1, size - overlap))
    return out


def test_windows_by_a_loop(spark):
    texts = ["", "short", "aé" * 40, "€uro " * 30, "😀" * 25, "x" * 100, "é", "ab😀€é" * 17]
    docs = spark.createDataFrame([(i, "u", "k", t) for i, t in enumerate(texts)] + [(99, "u", "k", None)], DOC)
    for size, overlap in [(30, 5), (16, 4), (9, 2), (1000, 100)]:
        got = {}
        for r in windows(docs, size, overlap).orderBy("chunk_id").collect():
            got.setdefault(r.document_id, []).append((r.char_start, r.char_end))
            assert texts[r.document_id].encode()[r.char_start : r.char_end].decode() == r.text
            assert r.token_count == (r.char_end - r.char_start) // 4
        assert got == {i: slow_windows(t, size, overlap) for i, t in enumerate(texts) if t}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aé€😀 ", max_size=60), st.integers(6, 20), st.integers(0, 5))
def test_windows_cover_the_text(spark, text, size, overlap):
    got = [(r.char_start, r.char_end) for r in windows(spark.createDataFrame([(1, "u", "k", text)], DOC), size, overlap).orderBy("ordinal").collect()]
    assert got == slow_windows(text, size, overlap)


@pytest.mark.parametrize(("size", "overlap"), [(6, 5), (4, 3), (2, 1), (1, 0), (3, 5)])
def test_steps_shorter_than_a_character(spark, size, overlap):
    text = "😀" * 5 + "aé€"
    got = [(r.char_start, r.char_end) for r in windows(spark.createDataFrame([(1, "u", "k", text)], DOC), size, overlap).orderBy("ordinal").collect()]
    assert got == slow_windows(text, size, overlap)
    assert all(text.encode()[s:e].decode() for s, e in got)


def test_ids_beyond_their_places(spark):
    docs = spark.createDataFrame([(10_000_000_000, "u", "k", "Abcdefff Abcdefff"), (10_000_000_001, "u", "k", "Abcdefff"), (-4, "u", "k", "Abcdefff"), (1, "u", "k", "Abcdefff")], DOC)
    m = mentions(windows(docs)).collect()
    assert len({r.mention_id for r in m}) == len(m) == 5
    assert sorted(r.mention_id >= 0 for r in m) == [False] * 4 + [True]


def test_a_text_of_60_mb(spark):
    docs = spark.range(1).selectExpr("id as document_id", "'u' as user_id", "'k' as kb_id", "repeat('Lorem ipsum dolor sit amet. ', 2200000) as text")
    w = windows(docs, 600, 60).agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids"), F.max("char_end").alias("end")).first()
    assert w.n == w.ids > 100_000 and w.end == 28 * 2_200_000


def test_density_guard_and_order(spark):
    name = lambda i: "Abcde" + "f" * 3
    text = lambda n: " ".join(name(i) for i in range(n))
    docs = spark.createDataFrame([(1, "u", "k", text(25)), (2, "u", "k", text(26)), (3, "u", "k", "Abcdefff"), (4, "v", "k", text(2))], DOC)
    m = mentions(windows(docs, 3000, 300))
    e = edges(m)
    assert {r.document_id: r["count"] for r in e.groupBy("document_id").count().collect()} == {1: 300, 4: 1}
    assert e.where("a >= b").count() == 0
    c = {r.user_id: (r.mention_count, r.document_count) for r in canonical(resolve(m)).collect()}
    assert c == {"u": (52, 3), "v": (2, 1)}


def test_scope_refuses_and_separates(spark):
    with pytest.raises(PermissionError):
        TenantScope("")
    df = spark.createDataFrame([(1, "u", "k", "t"), (2, "v", "k", "t")], DOC)
    assert [r.document_id for r in TenantScope("v", "k").apply(df).collect()] == [2]
    assert TenantScope("v", "other").apply(df).count() == 0


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "document_id long, v string")
    assert sorted(map(tuple, replace_documents(old, new).collect())) == [(1, "a"), (2, "c"), (3, "d"), (3, "d")]
    assert [r.document_id for r in insert_new(old, new, ["document_id"]).collect()] == [3]


def test_text_functions(spark):
    df = spark.createDataFrame([("ＡＢ　 c ", "x/Y.JPG"), ("plain", "noext"), (None, None)], "t string, n string")
    got = [tuple(r) for r in df.select(normalized(F.col("t"), True), content_type(F.col("n"))).collect()]
    assert got == [("ab c", "image/jpeg"), ("plain", None), (None, None)]


def test_windows_and_default_mentions_pass_texts_in_pieces(spark, monkeypatch):
    # Bytes are cut in the workers, in pieces that don't depend on how many windows a text has.
    from graphloom.operators import model

    monkeypatch.setattr(model, "_PIECE", 64)
    text = "Anna ärgert Bernd. Caro € Dora 😀 Emil " * 20
    docs = spark.createDataFrame([(1, "u", "k", text), (2, None, "k", text), (3, "u", "k", "")], DOC)
    w = windows(docs, 50, 7)
    assert "MapInArrow" in w._jdf.queryExecution().toString()
    rows = sorted(w.where("document_id = 1").collect(), key=lambda r: r.ordinal)
    assert [(r.char_start, r.char_end) for r in rows] == slow_windows(text, 50, 7)
    assert all(r.text.encode() == text.encode()[r.char_start : r.char_end] for r in rows)
    m = mentions(w, threshold=0.0)
    at = {r.chunk_id: r.text.encode() for r in w.collect()}
    assert all(at[r.chunk_id][r.char_start : r.char_end].decode() == r.text for r in m.collect())
    assert m.where("document_id = 2").count() == m.where("document_id = 1").count() > 0
    # Mentions of no tenant have no identity, and both ways to the identities agree.
    r = resolve(m, compatibility=False)
    assert r.where("user_id is null").count() == 0
    assert sorted(model.identities(r).collect()) == sorted(canonical(r).select(*model.identities(r).columns).collect())


def test_mentions_in_one_pass(spark, small, monkeypatch):
    """The mentions of all windows, with words cut by windows' ends, and in pieces smaller than a text; the windows' texts don't leave the task."""
    from graphloom.operators import model

    monkeypatch.setattr(model, "_PIECE", 64)
    rng = random.Random(5)
    texts = ["", "A", "Abc", "Word", "AWordé Word", "Éclat Paris 😀Wien", "Longword" * 40, "x" * 90] + ["".join(rng.choice("AABcdefgh éß。. \n") for _ in range(rng.randrange(1, 300))) for _ in range(30)]
    docs = spark.createDataFrame([(i, "u", "k", t) for i, t in enumerate(texts)] + [(99, "u", "k", None)], DOC).repartition(3)
    for size, overlap in [(600, 60), (20, 3), (7, 4), (3, 2)]:
        want = mentions(windows(docs, size, overlap), threshold=0.0)
        got = window_mentions(docs, size, overlap, threshold=0.0)
        assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect())
        by_regex = [(r.chunk_id, x.start(), x.group().decode()) for r in windows(docs, size, overlap).collect() for x in re.finditer(rb"[A-Z][a-z]{3,}", r.text.encode())]
        assert sorted(by_regex) == sorted((r.chunk_id, r.char_start, r.text) for r in got.collect())
    plan = Model(spark, small).mentions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
