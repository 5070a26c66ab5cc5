from pyspark.sql import functions as F

from graphloom.operators.blocks import FooterFilter, blocks, relation_label
from graphloom.operators.lifecycle import allowed_window
from graphloom.operators.retrieval import NOT_FOUND, parse_answer
from graphloom.streaming.stateful import enqueue, transition


def test_job_states():
    assert enqueue(None, 0) == ("pending", 1, True)
    assert enqueue("processing", 2) == ("processing", 2, False)
    assert enqueue("failed", 2) == ("pending", 3, True)
    assert transition("processing", 1, 1, "succeeded", "embedding", "x") == ("succeeded", "", "", "changed")
    assert transition("succeeded", 1, 1, "succeeded") == ("succeeded", "", "", "same")
    assert transition("succeeded", 1, 1, "failed") == ("succeeded", "", "", "not_active")
    assert transition("pending", 2, 1, "failed") == ("pending", "", "", "superseded")
    assert transition("pending", 1, 1, "pending") == ("pending", "", "", "invalid")
    assert transition("pending", 1, 1, "processing", new_phase="a") == ("processing", "a", "", "changed")
    assert transition("processing", 1, 1, "processing", "a") == ("processing", "a", "", "same")
    assert transition("processing", 1, 1, "processing", "a", "", "b") == ("processing", "b", "", "changed")
    assert transition("processing", 1, 1, "failed", "a", "", "", "why") == ("failed", "a", "why", "changed")
    assert transition("failed", 1, 1, "failed", "a", "why", "", "again") == ("failed", "a", "why", "same")


def test_footer_filter():
    for cut in range(1, 25):
        text = "Citadel cit. Citations: 1, 2"
        f = FooterFilter()
        shown = "".join(f.write(text[i : i + cut]) for i in range(0, len(text), cut)) + f.flush()
        assert shown == "Citadel cit. "
    f = FooterFilter()
    assert f.write("ends in cita") == "ends in " and f.flush() == "cita"


def test_blocks(spark):
    text = "junk\nCandidate: A\nVERDICT: yes\nverdict: late\nCANDIDATE: B\nCANDIDATE: C\n verdict : x\nVERDICT:"
    got = spark.createDataFrame([(text,)], "t string").select(blocks(F.col("t"), "CANDIDATE", "VERDICT").alias("b")).first().b
    assert [tuple(x) for x in got] == [("A", "yes"), ("B", None), ("C", "")]
    df = spark.createDataFrame([("NONE",), ("",), (None,), ("Owns ",)], "v string")
    assert [r[0] for r in df.select(relation_label(F.col("v"))).collect()] == ["none", "none", "none", "owns"]


def test_answers(spark):
    rows = [("text CITATIONS: x\nCitations: 3, 1, 3, 0, 9, z", 3), ("no footer ", 3), (NOT_FOUND, 3), ("citations:", 2)]
    df = parse_answer(spark.createDataFrame(rows, "r string, n int"), F.col("n"), F.col("r"))
    got = [(r.summary.strip(), r.cited) for r in df.collect()]
    assert got == [("text CITATIONS: x", [3, 1]), ("no footer", []), (NOT_FOUND, []), ("", [])]


def test_window_is_strict(spark):
    rows = [("a", i, t) for i, t in enumerate([0, 10, 60, 61, 120, 122])]
    df = spark.createDataFrame(rows, "key string, id long, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.allowed for r in allowed_window(df, 1, 60).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False, 5: True}
