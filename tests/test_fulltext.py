import pytest

from graphloom.functions.stem import stem
from graphloom.operators.fulltext import Saved, index, parse, save, search, top

# Examples of the paper, step by step.
STEMS = (
    "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop "
    "falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat rational:ration valenci:valenc vietnamization:vietnam operator:oper hopefulness:hope "
    "sensibiliti:sensibl triplicate:triplic electriciti:electr goodness:good allowance:allow replacement:replac adoption:adopt communism:commun probate:probat rate:rate cease:ceas controll:control "
    "roll:roll generalizations:gener oscillators:oscil licenses:licens license:licens élan:élan as:as"
)
TEXTS = {
    1: "Two cats sat in the big house, and the cats slept.", 2: "A dog ran past houses that were big", 3: "Licensing: one license, many licenses", 4: "café élan naïve",
    5: "the of and", 6: None, 7: "", 8: "big cats run; a house stands far away from them all", 9: "state-of-the-art dogs",
}


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    rows = [(k, "u", "k", t) for k, t in TEXTS.items()] + [(11, "v", "k", TEXTS[1])]
    chunks = spark.createDataFrame(rows, "chunk_id long, user_id string, kb_id string, text string")
    path = str(tmp_path_factory.mktemp("index") / "ix")
    save(index(chunks), path, shards=5)
    return Saved(spark, path), chunks


def test_stems(spark):
    rows = [tuple(x.split(":")) for x in STEMS.split()]
    got = spark.createDataFrame(rows, "w string, s string").select("w", "s", stem("w").alias("g")).where("s <> g").collect()
    assert got == []


def ids(df):
    return sorted(r.chunk_id for r in df.where("user_id = 'u'").collect())


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("license", [3]), ("cat", [1, 8]), ("Cats house", [1, 8]), ("cats or dogs", [1, 2, 8, 9]), ("cats -slept", [8]), ('"big house"', [1]), ('"house that were big"', [2]), ("café", [4]), ("caf", []), ("élan or lan", [4]),
        ("the", []), ("", []), ("cat big or license", [1, 3, 8]), ('"state of the art"', [9]), ("state-of-the-art", [9]), ('-"big house" cats', [8]), ("or", []),
    ],
)
def test_queries(saved, q, want):
    assert ids(search(saved[0], q)) == want


def test_negations_only_need_the_chunks(saved):
    with pytest.raises(ValueError, match="negations"):
        search(saved[0], "-cats")
    assert ids(search(saved[0], "-cats", saved[1])) == [2, 3, 4, 5, 6, 7, 9]


def test_tenants_stay_apart_and_nearer_words_rank_higher(saved):
    rows = [(r.user_id, r.chunk_id, r.rank) for r in top(saved[0], "big house", 2).collect()]
    assert sorted(rows) == [("u", 1, 1), ("u", 2, 2), ("v", 11, 1)]
    more = {r.chunk_id: r.score for r in search(saved[0], "license or cats").where("user_id = 'u'").collect()}
    assert more[3] > more[1] > more[8]


def test_a_query_reads_its_terms_only(saved):
    plan = saved[0].of(["cat"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters")[1][:80] and "In(term" in plan or "EqualTo(term" in plan


def test_offsets_of_a_phrase(spark):
    assert parse(spark, '"house of the cats" -x-ray or y') == [[(False, [(0, "hous"), (3, "cat")]), (True, [(0, "x"), (1, "rai")])], [(False, [(0, "y")])]]


def test_empty_table(spark, tmp_path):
    save(index(spark.createDataFrame([], "chunk_id long, user_id string, kb_id string, text string")), str(tmp_path / "none"))
    assert search(Saved(spark, str(tmp_path / "none")), "word").collect() == []


def test_stems_by_word_and_by_sql_are_the_same(spark):
    from graphloom.functions.stem import STEPS, stem_word

    ends = sorted({e for step in STEPS for e, *_ in step if "#" not in e} | {"eed", "ed", "ing", "s", "y"})
    words = [a + b for a in ("", "b", "tr", "hopp", "agre", "relat", "conform", "feed", "y", "sky", "élan", "a1") for b in ends] + ["as", "", "it's"]
    got = spark.createDataFrame([(w, stem_word(w)) for w in words], "w string, s string").select("w", "s", stem("w").alias("g")).where("s <> g").collect()
    assert got == []


def test_words_of_any_script_and_places(spark):
    texts = [(1, "Ünter-größe 12ab Жук_x 日本語。𝒜b ½"), (2, ""), (3, None), (4, "größe"), (4, "eine größe"), (5, "größe" * 2 + " größe")]
    rows = index(spark.createDataFrame([(i, "u", None, t) for i, t in texts], "chunk_id long, user_id string, kb_id string, text string").coalesce(1))
    want = spark.createDataFrame([t for _, t in texts if t], "string").selectExpr(r"explode(regexp_extract_all(lower(value), '([\\p{L}\\p{N}]+)', 1)) as w").select(stem("w").alias("w"))
    assert sorted(r.term for r in rows.collect()) == sorted({r.w for r in want.collect()})
    r = rows.where("term = 'größe'").first()
    assert (r.chunk_ids, r.ends, r.places) == ([1, 4, 4, 5], [1, 2, 3, 4], [2, 1, 2, 2])


def test_an_index_is_made_without_a_shuffle(spark):
    """Its steps were two shuffles of all words before; equal ids of chunks are merged by readers."""
    c = spark.createDataFrame([(1, "u", "k", "cat")], "chunk_id long, user_id string, kb_id string, text string")
    assert "Exchange" not in index(c)._jdf.queryExecution().toString()


def test_chunks_that_share_an_id_count_together(spark, tmp_path):
    c = spark.createDataFrame([(1, "u", "k", "cat"), (1, "u", "k", "a cat"), (2, "u", "k", "dog")], "chunk_id long, user_id string, kb_id string, text string").repartition(3)
    save(index(c), str(tmp_path / "ix"), shards=3)
    got = search(Saved(spark, str(tmp_path / "ix")), "cats or dogs").collect()
    assert sorted(r.chunk_id for r in got) == [1, 2]
    assert max(got, key=lambda r: r.score).chunk_id == 1
