"""Sentences and what is found in them, against plain loops over characters."""

import random
import re
import time

from pyspark.sql import functions as F

from graphloom.operators.model import mentions
from graphloom.operators.sentences import byte_starts, found, pattern_matches, sentences, sums_before

SPACE, CLOSING, STOPS = " \t\r\n\f", "\"')]»”’", ".!?"
SHORT = {"Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Sr", "Jr", "vs", "cf", "e.g", "i.e", "z.B"}


def plain(text):
    """Sentences by walking over the text once, a character at a time."""
    out, begin, i, n = [], 0, 0, len(text)
    while i < n:
        ch, end = text[i], None
        if ch in STOPS:
            j = i
            while j < n and text[j] in STOPS:
                j += 1
            word = re.search(r"[A-Za-z.]*$", text[:i]).group()
            short = text[i:j] == "." and (word in SHORT or word.split(".")[-1] in SHORT | set("ABCDEFGHIJKLMNOPQRSTUVWXYZ") or any(word.endswith("." + s) for s in SHORT))
            k = j
            while k < n and text[k] in CLOSING:
                k += 1
            if k < n and text[k] in SPACE and not short:
                end = k
            else:
                i = j
                continue
        elif ch in "。！？":
            end = i
            while end < n and text[end] in "。！？":
                end += 1
        elif ch == "\n" and re.match(r"\n[ \t\r\f]*\n", text[i:]):
            end = i
        if end is None:
            i += 1
            continue
        while end < n and text[end] in SPACE:
            end += 1
        out.append(text[begin:end])
        begin = i = end
    return out + ([text[begin:]] if begin < n else [])


def test_sentences_tile_the_text(spark):
    rng = random.Random(3)
    parts = ["Dr", "Smith", "é", "日本", "。", ".", ".", "!", "?", "...", " ", " ", "\n", "\n\n", "\t", '"', ")", "A", "b", "e.g.", "vs.", "xDr", "End", "1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", None, ".", "\n\n", " lead. x", "Dr. No said so. Yes."]
    rows = sentences(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.chunk_id, r.sentence)):
        got.setdefault(r.chunk_id, []).append(r)
    for i, t in enumerate(texts):
        mine = got.get(i, [])
        assert [r.text for r in mine] == plain(t or ""), repr(t)
        assert [r.sentence for r in mine] == list(range(len(mine)))
        at = 0
        for r in mine:
            assert (r.char_start, r.char_end) == (at, at + len(r.text.encode()))
            at = r.char_end


def test_matches_are_rebased(spark):
    rng = random.Random(5)
    words = ["Über", "Anna", "Berlin.", "é", "gegen ", "Dr. ", "Paul! ", "\n\n", "日本。", " ", "Xavier "]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").select("chunk_id", found(F.col("text"), pattern_matches("[A-Z][a-z]{3,}")).alias("f"))
    for r in df.collect():
        t = texts[r.chunk_id]
        assert [(x.m, x.s) for x in r.f] == [(m.group(), len(t[: m.start()].encode())) for m in re.finditer("[A-Z][a-z]{3,}", t)]


def test_a_match_stays_in_its_sentence_and_a_finder_can_be_given(spark):
    c = spark.createDataFrame([(1, 1, "u", "k", "New York. New Delhi is far. New\nYork")], "chunk_id long, document_id long, user_id string, kb_id string, text string")
    got = mentions(c, pattern="[A-Z][a-z]+[ .\n]+[A-Z][a-z]+", threshold=0.0).orderBy("char_start").collect()
    assert [(r.text, r.char_start) for r in got] == [("New York", 0), ("New Delhi", 10), ("New\nYork", 28)]
    first = lambda s: F.array(F.struct(F.left(s, F.lit(3)).alias("m"), F.lit(0).alias("s")))
    got = mentions(c, threshold=0.0, find=first).orderBy("char_start").collect()
    assert [(r.text, r.char_start) for r in got] == [("New", 0), ("New", 10), ("New", 28)]


def test_sums_and_long_texts(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        want = [i * (i - 1) // 2 for i in range(n)]
        assert spark.range(1).select(sums_before(F.lit(list(range(n))).cast("array<int>")).alias("x")).first().x == want
    assert spark.sql("select cast(null as array<string>) as t").select(byte_starts(F.col("t")).alias("x")).first().x is None

    def took(words):
        df = spark.createDataFrame([(1, "Anna met Paul. " * words + "." * words + " " * words)], "chunk_id long, text string")
        begin = time.time()
        assert df.select(F.size(found(F.col("text"), pattern_matches("[A-Z][a-z]{3,}"))).alias("n")).first().n == 2 * words
        return time.time() - begin

    took(1000)
    assert took(100_000) < 40  # seconds; work that grows with the square would take hours
