import pytest
from pyspark.sql import functions as F

from graphloom.operators.lifecycle import allowed_window
from graphloom.sources.versions import COUNTS, Versions, merge_counts, replace_documents_everywhere

SCHEMAS = {"chunks": "document_id long, text string", "mentions": "document_id long, name string"}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_document_goes_through_all_tables_or_none(spark, tmp_path):
    t = Versions(spark, str(tmp_path / "t"), SCHEMAS)
    assert t.numbers() == [] and rows(t.read("chunks")) == []
    chunks, names = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMAS["chunks"]), spark.createDataFrame([(1, "A"), (2, "B")], SCHEMAS["mentions"])
    assert t.commit(1, {"chunks": chunks, "mentions": names})
    gone = spark.createDataFrame([(1,)], "document_id long")
    broken = spark.createDataFrame([(1, "A")], SCHEMAS["mentions"]).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        replace_documents_everywhere(t, 2, gone, {"chunks": spark.createDataFrame([(1, "new")], SCHEMAS["chunks"]), "mentions": broken}, ["chunks", "mentions"])
    assert t.numbers() == [1] and rows(t.read("chunks")) == [(1, "a"), (2, "b")] and rows(t.read("mentions")) == [(1, "A"), (2, "B")]
    assert replace_documents_everywhere(t, 2, gone, {"chunks": spark.createDataFrame([(1, "new")], SCHEMAS["chunks"])}, ["chunks", "mentions"])
    assert rows(t.read("chunks")) == [(1, "new"), (2, "b")] and rows(t.read("mentions")) == [(2, "B")]
    assert rows(t.read("chunks", 1)) == [(1, "a"), (2, "b")]
    t.commit(3, {"mentions": None})
    t.forget(keep=1)
    assert t.numbers() == [3] and rows(t.read("mentions")) == [] and rows(t.read("chunks")) == [(1, "new"), (2, "b")]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    merge = merge_counts(str(tmp_path / "t"), shards=3)
    change = lambda *x: spark.createDataFrame([("u", "k", n, "t", c) for n, c in x], "user_id string, kb_id string, normalized_text string, entity_type string, change int")
    now = lambda: {r.normalized_text: r.mention_count for r in Versions(spark, str(tmp_path / "t"), {"counts": COUNTS}).read_all("counts").collect()}
    merge(change(("a", 1), ("a", 1), ("b", 1), ("c", 1)), 0)
    assert now() == {"a": 2, "b": 1, "c": 1}
    merge(change(("b", -1), ("a", -1)), 1)
    merge(change(("b", -1), ("a", -1)), 1)
    assert now() == {"a": 1, "c": 1}
    merge(change(), 2)
    merge(change(("b", 1)), 3)
    assert now() == {"a": 1, "b": 1, "c": 1}


def test_a_key_of_a_million_events(spark):
    e = spark.range(1_000_000).select(F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("key"), "id", F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    got = allowed_window(e, 2, 60).where("allowed").groupBy("key").count()
    counts = {r.key: r["count"] for r in got.collect()}
    assert counts["rare"] == 10_000 and 200_000 < counts["hot"] < 230_000


def test_sums_beyond_64_bits_stay_whole(spark):
    from graphloom.sources.lineage import as_longs, whole_sum

    rows = spark.createDataFrame([("a", 1 << 62), ("a", 1 << 62), ("b", 5)], "k string, x long")
    sums = lambda df: as_longs(df.groupBy("k").agg(whole_sum(df["x"]).alias("s")), "s")
    assert {r.k: int(r.s) for r in sums(rows).collect()} == {"a": 1 << 63, "b": 5}
    small = sums(rows.where("k = 'b'"))
    assert small.schema["s"].dataType.simpleString() == "bigint" and small.first().s == 5
    assert sums(rows.limit(0)).count() == 0
