import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.packing import CAPACITY, Tokenizing, best_fit_decreasing, certificate, lower_bound, pack, pieces


def whole(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _tok
    if "_tok" not in globals():
        _tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return np.array([*_tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


MORSE = "a"
for _ in range(10):  # polynomial hashes modulo 2**64 of this word and of its complement agree
    MORSE += MORSE.translate(str.maketrans("ab", "ba"))
ODD = ["", None, "a", "It's  the END\x85of 12'345 «x» <|endoftext|> it!", "don't stop", "É ÀÖ ß ÿ Ā Σας ²", "x\x00y\x1fz", "naïvé café", "!!??..,,__--", "東京 123", "a" * 3000, "w1 " * 9000, "<|startoftext|>", " ok ok"]


def test_ids_and_places(spark, small, monkeypatch):
    from graphloom.llm import packing

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id")], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    cut = pieces(docs)
    bound = lower_bound(np.array([r.length for r in cut.collect()]))
    assert pack(cut).select("sequence_id").distinct().count() <= bound + 1
    monkeypatch.setattr(packing, "LEAST_SEQUENCES", 1)
    got = pack(cut, per_partition=40).collect()
    monkeypatch.undo()
    seen, seqs = {}, {}
    for r in got:
        ids = whole(texts[r.doc_id])
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length and r.start == r.piece * CAPACITY
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {d: len(whole(t)) for d, t in texts.items()}
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert len(seqs) <= 1.1 * bound + 1  # tiny partitions leave gaps
    assert certificate(pack(cut)) == (pack(cut).select("sequence_id").distinct().count(), bound)
    # Partitions that reach their bounds don't leave an open sequence each.
    even = spark.range(4000).selectExpr("id as doc_id", "cast(1 + id % 3 as long) as length")
    assert certificate(pack(even, per_partition=100)) == (2, 2)


def test_words_of_one_name_are_noticed():
    data = np.frombuffer(b"abcdefghi abcdefghj", np.uint8)
    start, end = np.array([0, 10]), np.array([9, 19])
    Tokenizing._compare(data, start, end, np.array([0, 1]))
    with pytest.raises(RuntimeError):
        Tokenizing._compare(data, start, end, np.array([0, 0]))


def test_invalid_text(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text union all select 2L, cast(unhex('C4') as string)")
    got = {r.doc_id: r for r in pieces(docs).collect()}
    assert got[1].ids_crc32 == zlib.crc32(whole("a\ufffdb").tobytes()) and got[2].ids_crc32 == zlib.crc32(whole("\ufffd").tobytes())


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, length string")
    assert pack(pieces(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_bound_never_exceeds_a_packing(sizes):
    sizes = np.array(sizes, np.int64)
    bins = best_fit_decreasing(sizes, 50)
    if len(sizes):
        assert np.bincount(bins, weights=sizes).max() <= 50
        assert lower_bound(sizes, 50) <= bins.max() + 1


def test_bound_sees_large_items():
    assert lower_bound(np.array([26] * 10), 50) == 10
    assert lower_bound(np.array([17] * 9 + [30]), 50) == 6 - 1 or lower_bound(np.array([17] * 9), 50) == 5
