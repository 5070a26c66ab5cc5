import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import token_alignment
from graphloom.llm.token_alignment import align, pair_counts
from graphloom.llm.word_tokens import public_path


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))


def alphabet():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows, sides):
    """Brute force: the libraries on whole texts, tokens laid over bytes one by one, all pairs written out."""
    a, b = sides
    back, docs, held = alphabet(), [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(back[c] for c in a.id_to_token(i)) for i in ia]
            bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                i = j = x = y = 0
                group = ([], [])
                while i < len(ia) or j < len(ib):
                    if x <= y and i < len(ia):
                        x += len(ba[i])
                        group[0].append(ia[i])
                        i += 1
                    else:
                        y += len(bb[j])
                        group[1].append(ib[j])
                        j += 1
                    if x == y and group[0] and group[1]:
                        groups.append(group)
                        group = ([], [])
        links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        held.update(links.keys())
        docs.append((doc, groups, links))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for doc, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(links.values()), sum(n for (p, q), n in links.items() if held[p, q] == best[p]), sum(n * held[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str), held, best


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TEXTS = ["the quick brown fox", "the quick", None, "", " ", "\n", "a\n\n b  c", "<|endoftext|> <s> text", "ein a▁b", "日本語のテキスト with “quotes”", "don't we'll", "x" * 700, "zzzz " * 50, "é\x00ß", "a  ", "\t tab"]


def test_documents_equal_brute_force(spark, sides):
    rows = [*enumerate(TEXTS), (3, "the quick brown fox"), (None, "the fox"), (3, "the quick brown fox")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as stripe", "2 as chunk", "3 as place", "'x' as block").repartition(4)
    want, held, best = brute(rows, sides)
    got, counts = align(docs)
    assert rows_of(got) == want
    assert {(r.a, r.b): (r.n_docs, r.best) for r in pair_counts(counts).collect()} == {k: (n, n == best[k[0]]) for k, n in held.items()}


def test_small_chunks_and_split_stripes_change_nothing(spark, sides, monkeypatch):
    rows = [(i, f"{TEXTS[i % 2]} number {i} of many") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, sides)[0]
    monkeypatch.setattr(token_alignment, "SCORED", 7)
    assert rows_of(align(docs)[0]) == want


def test_long_groups_and_chunks(sides, monkeypatch):
    """Groups of many tokens are taken as distinct ids; the pairs are the same."""
    import numpy as np

    own = token_alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    texts = [" " + t for t in TEXTS if t]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    results = []
    for wide in (64, 0):
        monkeypatch.setattr(token_alignment, "WIDE", wide)
        results.append([x.tolist() for x in own.slice(offsets, data)[1]])
    assert results[0] == results[1]


def test_empty_table_and_bytes_beyond_utf8(spark, sides):
    none = align(spark.createDataFrame([], "doc_id long, text string"))
    assert none[0].collect() == [] and none[1].collect() == []
    odd = spark.range(1).selectExpr("id as doc_id", "cast(X'61FF62' as string) as text")
    assert rows_of(align(odd)[0]) == brute([(0, "a�b")], sides)[0]


def test_one_text_of_50_mb(spark):
    docs = spark.range(2).selectExpr("id as doc_id", "if(id = 0, repeat('lorem ipsum dolor ', 2800000), 'lorem') as text")
    got = {r.doc_id: r for r in align(docs)[0].collect()}
    assert got[0].n_a > 10_000_000 and got[0].n_best > 0 and got[1].n_links > 0


def test_query_on_the_small_tables(spark, small, sides):
    from graphloom.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op13_token_alignment"](spark, small)) == brute(rows, sides)[0]
