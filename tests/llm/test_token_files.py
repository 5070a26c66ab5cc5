import heapq
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import huffman
from graphloom.llm.token_files import read, write
from graphloom.llm.word_tokens import ByteLevel, Pieces, public_path

SCHEMA = "doc_id long, text string, ids string"
SIGNS = ["a", "b", "s", "t", "re", "ll", "'", " ", "  ", "\n", "\t", "1", "23", ".", ",", "é", "ß", "×", "<|endoftext|>", "<|", "日本", "“", "▁", "\x00", "\xa0", "'s", "end", "\x85", "\x1c"]


def whole():
    return Tokenizer.from_file(public_path("byte_bpe_50k.json"))


def expected(rows):
    """Brute force: the library on whole texts, one after the other."""
    tok, at, out = whole(), 0, []
    for doc, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=20).map("".join), max_size=12))
def test_ids_are_the_librarys(texts):
    own, words = ByteLevel(public_path("byte_bpe_50k.json"), True), []
    for _, ids, bounds in own.rows(pa.array(texts, pa.string())):
        words += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert words == [own.whole.encode(t, add_special_tokens=False).ids for t in texts]
    own, words = Pieces(public_path("piece_bpe_32k.model")), []
    for _, ids, bounds in own.rows(pa.array([" " + t for t in texts], pa.string())):
        words += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert words == [own.whole.encode(t) or [own.alone] for t in texts]  # an empty text's own space is dropped by the caller


def test_words_that_share_a_name_are_encoded_whole(monkeypatch):
    from graphloom.llm import word_tokens

    monkeypatch.setattr(word_tokens, "names", lambda data, start, end: (end - start).astype(np.uint64))
    own = ByteLevel(public_path("byte_bpe_50k.json"), True)
    texts = ["extraordinary circumstances", "circumnavigated extraordinary", "perpendicular"]
    for _ in range(2):
        got = [ids[a:b].tolist() for _, ids, bounds in own.rows(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [own.whole.encode(t).ids for t in texts]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 2000), min_size=2, max_size=80), st.integers(7, 20))
def test_lengths_are_the_best_prefix_code(counts, limit):
    counts = np.array(counts)
    size = huffman.code_lengths(counts, limit)
    assert ((size > 0) == (counts > 0)).all() and size.max(initial=0) <= limit
    assert sum(2.0 ** -int(x) for x in size[size > 0]) <= 1
    if limit == 20 and (counts > 0).sum() > 1:
        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert int((size * counts).sum()) == cost or size.max() == 20


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 300), max_size=1500))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    size = huffman.code_lengths(np.bincount(ids, minlength=301))
    bits, at = huffman.encode(ids, size, huffman.codes(size))
    entries, top = huffman.table(size)
    assert (huffman.decode(bits, at, len(ids), entries, top) == ids).all()
    # A checkpoint is enough to begin at.
    if len(at) > 1:
        rest = huffman.decode(bits, at[1:], len(ids) - huffman.STRIDE, entries, top)
        assert (rest == ids[huffman.STRIDE :]).all()


def test_codes_are_canonical_and_free_of_prefixes():
    size = huffman.code_lengths(np.array([5, 1, 1, 0, 9, 2]))
    code = huffman.codes(size)
    strings = [format(int(c), f"0{n}b") for c, n in zip(code, size, strict=True) if n]
    assert all(not b.startswith(a) for a in strings for b in strings if a != b)
    order = sorted((int(n), i) for i, n in enumerate(size) if n)
    assert [int(code[i]) for _, i in order] == sorted(int(code[i]) for _, i in order)


def test_files_hold_what_the_library_gives(spark, tmp_path):
    rows = [(7, "a long text\n\n  of words"), (3, None), (9, ""), (None, "no id"), (5, "<|endoftext|> is a token"), (8, "word " * 30_000), (11, "日本語 “quotes” don't"), (4, "x")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(3)
    path = write(docs, str(tmp_path / "files"), block_ids=50)
    got = [tuple(r) for r in read(spark, path).orderBy("start").collect()]
    assert got == expected(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    ids = {r.doc_id: r.ids for r in read(spark, path, ids=True).collect()}
    assert ids[4] == [*whole().encode("x").ids, 0] and len(ids[8]) > 30_000
    assert spark.read.parquet(f"{path}/blocks").count() == 3  # the long text stands alone


def test_repeated_rows_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "b", 2), (0, "a", 2)], "doc_id long, text string, part int")
    got = sorted((r.start, r.doc_id, r.ids_crc32) for r in read(spark, write(docs)).collect())
    crc = {t: e[3] for t in "ab" for e in expected([(0, t)])}
    assert [g[:2] for g in got] == [(0, 0), (2, 1), (4, 1), (6, 1)]
    assert sorted(g[2] for g in got[1:]) == sorted([crc["a"], crc["b"], crc["b"]])


def test_empty_table_and_bytes_beyond_utf8(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert read(spark, write(none)).collect() == []
    odd = spark.range(1).selectExpr("id as doc_id", "cast(X'61FF62' as string) as text")
    assert [tuple(r) for r in read(spark, write(odd)).collect()] == expected([(0, "a�b")])


def test_one_text_of_50_mb(spark):
    docs = spark.range(2).selectExpr("id as doc_id", "if(id = 0, repeat('lorem ipsum dolor ', 2800000), 'x') as text")
    got = {r.doc_id: r for r in read(spark, write(docs)).collect()}
    assert got[1].start == got[0].n_tokens and got[0].n_tokens > 10_000_000


@pytest.mark.parametrize("name", ["op11_token_files"])
def test_query_on_the_small_tables(spark, small, name):
    from graphloom.llm.queries import QUERIES

    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in QUERIES[name](spark, small).collect()) == expected(rows)
