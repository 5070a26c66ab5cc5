import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import line_dedup
from graphloom.llm.line_dedup import deduplicate, probes, segments, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_band_by_brute_force():
    r = random.Random(6)
    pairs = []
    for _ in range(800):
        a = bytes(r.choice(b"ab") for _ in range(r.randrange(0, 30)))
        b = bytearray(a)
        for _ in range(r.randrange(0, 5)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(0, 2)] = bytes(r.choice(b"abc") for _ in range(r.randrange(0, 2)))
        pairs.append((a, bytes(b)))
    for e in (1, 2, 3, 7):
        got = within([a for a, _ in pairs], [b for _, b in pairs], np.full(len(pairs), e))
        assert got.tolist() == [distance(a, b) <= e for a, b in pairs]
    pairs = []
    for _ in range(250):
        a = bytes(r.choice(b"abcd ") for _ in range(r.randrange(0, 260)))
        pairs.append((a, changed(r, a, r.randrange(0, 40))))
    edits = np.array([r.randrange(1, line_dedup.WORD_EDITS + 1) for _ in pairs])
    got = within([a for a, _ in pairs], [b for _, b in pairs], edits)
    assert got.tolist() == [distance(a, b) <= e for (a, b), e in zip(pairs, edits.tolist(), strict=True)] and 20 < got.sum() < 230


def test_probes_find_every_near_line():
    r = random.Random(8)
    for _ in range(700):
        a = bytes(r.choice(b"abcd") for _ in range(r.randrange(6, 30)))
        b = bytearray(a)
        for _ in range(2):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(0, 2)] = bytes(r.choice(b"abcd") for _ in range(r.randrange(0, 2)))
        a, b = sorted((a, bytes(b)), key=len)
        if distance(a, b) <= 2:
            index = {(len(a), i, a[p : p + n]) for i, (p, n) in enumerate(segments(len(a), 2))}
            assert any((o, i, b[q : q + n]) in index for o, i, q, n in probes(len(b), 2))


def brute(rows, least=24, short=False):
    """(kept text, removed lines, links) by doc, with the budget that grows with the line; short: short lines that repeat go and count too."""
    lines = [(d, k, s) for d, t in rows if d is not None for k, s in enumerate((t or "").split("\n"))]
    raw = [s.encode() for _, _, s in lines]
    names = {b: i for i, b in enumerate(dict.fromkeys(raw))}
    texts = sorted(names, key=len)
    close = {b: {b} for b in names}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            e = line_dedup.budget(len(b))
            if len(b) - len(a) > e and len(b) >= least:
                if len(b) - len(a) > max(e, line_dedup.budget(len(a) * 2)):
                    break
                continue
            if len(a) >= least and line_dedup.may_align(a, b, e) and distance(a, b) <= e:
                close[a].add(b), close[b].add(a)
    at = {}
    for i, b in enumerate(raw):
        at.setdefault(b, []).append(i)
    comp = {}
    for i in sorted(range(len(lines)), key=lambda i: lines[i][:2]):
        if raw[i] not in comp:
            todo = [raw[i]]
            while todo:
                u = todo.pop()
                if u not in comp:
                    comp[u] = i
                    todo += close[u]
    out = {}
    for d, t in rows:
        if d is None:
            out[d] = (t, 0, 0)
            continue
        own = [i for i, x in enumerate(lines) if x[0] == d]
        may = [i for i in own if len(raw[i]) >= least or short and raw[i].strip()]
        gone = {i for i in may if comp[raw[i]] != i}
        kept = "\n".join(lines[i][2] for i in own if i not in gone)
        out[d] = (kept if gone else t, len(gone), sum(sum(len(at[b]) for b in close[raw[i]]) - 1 for i in may))
    return out


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randrange(2, 9)))
    base = [" ".join(word() for _ in range(r.randrange(1, 12))) for _ in range(25)]
    rows = []
    for d in range(60):
        ls = []
        for _ in range(r.randrange(0, 7)):
            s = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                k = r.randrange(len(s) + 1)
                s[k : k + r.randrange(0, 2)] = r.choice(["x", "", "y"])
            ls.append("".join(s))
        rows.append((d * 7 % 60, "\n".join(ls)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, base[0] + "\n"), (None, base[0])]
    want = brute(rows)
    assert sum(w[1] for w in want.values()) > 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("size", F.lit(1))
    for block in (512, 2):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        got = deduplicate(docs).collect()
        assert len(got) == len(rows)
        for g in got:
            assert (g.kept_text, g.n_repeats, g.n_links) == want[g.doc_id], g
            assert g.n_lines == len((g.text or "").split("\n"))


def test_empty(spark):
    assert deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def changed(r, s, edits):
    b = bytearray(s)
    for _ in range(edits):
        k = r.randrange(len(b) + 1)
        b[k : k + r.randrange(0, 2)] = bytes(r.choice(b"abcd ") for _ in range(r.randrange(0, 2)))
    return bytes(b)


def test_budget_grows_with_the_line(spark):
    r = random.Random(12)
    for _ in range(300):
        a = bytes(r.choice(b"abcd ") for _ in range(r.randrange(140, 500)))
        b = changed(r, a, r.randrange(0, 14))
        for e in (3, 6, 10):
            near = distance(a, b) <= e
            assert line_dedup.within_far(a, b, e) == near
            assert line_dedup.may_align(a, b, e) or not near
    rows, base = [], [bytes(r.choice(b"abcdefgh ") for _ in range(n)) for n in (140, 147, 149, 150, 151, 199, 200, 338, 362, 363, 700, 1500)]
    for b in base:
        rows += [b] + [changed(r, b, r.choice([1, 2, 3, len(b) // 50, len(b) // 50, len(b) // 50 + 1, len(b) // 25])) for _ in range(7)]
    # Edits spread evenly leave the shortest unchanged runs.
    for b in base:
        even = bytearray(b)
        for k in range(len(b) // 50):
            even[(k + 1) * len(b) // (len(b) // 50 + 1)] = 33
        rows.append(bytes(even))
    rows.append(base[7].replace(base[7][100:106], b"XYZUVW"))
    links = [sum(j != i and distance(a, b) <= line_dedup.budget(max(len(a), len(b))) for j, b in enumerate(rows) if abs(len(a) - len(b)) < 40) for i, a in enumerate(rows)]
    docs = spark.createDataFrame([(i, b.decode()) for i, b in enumerate(rows)], "doc_id long, text string")
    got = {g.doc_id: g for g in deduplicate(docs).collect()}
    assert [got[i].n_links for i in range(len(rows))] == links
    assert links[-1] > 0 and got[len(rows) - 1].n_repeats == 1


def test_query_counts_short_repeats(spark, tmp_path):
    from graphloom.llm.queries import op9_line_dedup

    long = "a line that is long enough to be joined by edits"
    rows = [(1, f"short\n\n{long}\n   "), (2, f"short\n\n{long}\n   "), (3, "shirt\nshort\nshort"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {g.doc_id: g for g in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert [(got[i].n_lines, got[i].n_repeats, got[i].n_near, got[i].n_links) for i in (1, 2, 3, 4)] == [(4, 0, 0, 4), (4, 2, 0, 4), (3, 2, 0, 6), (1, 0, 0, 0)]
    kept = [rows[0][1], "\n   ", "shirt", ""]
    assert [got[i].kept_sha256 for i in (1, 2, 3, 4)] == [hashlib.sha256(k.encode()).hexdigest() for k in kept]


def test_unlike_lines_and_shared_ids(spark):
    """Lines whose polynomial hashes modulo 2**64 agree are told apart; clashing columns give way; rows of one id."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    long = "a line that is long enough to be joined by edits"
    rows = [(1, word), (2, other), (3, f"{long}\nx"), (3, f"{long}\nx"), (3, f"y\n{long}"), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_repeats", F.lit("clash")).withColumn("kept_text", F.lit(0)).withColumn("_gone", F.lit(1))
    got = sorted((g.doc_id, g.text, g.n_repeats, g.kept_text, g._gone) for g in deduplicate(docs, short=True).collect())
    # Of the two texts of id 3, the one with the smaller hash comes first.
    one, two = f"{long}\nx", f"y\n{long}"
    kept = [(0, one), (1, "y")] if next(g.kept_text for g in [*deduplicate(docs).collect()] if g.text == two) == "y" else [(1, "x"), (0, two)]
    assert got == [(1, word, 0, word, 1), (2, other, 0, other, 1), (3, one, *kept[0], 1), (3, one, *kept[0], 1), (3, two, *kept[1], 1), (4, long, 1, "", 1)]


def test_counts_never_exceed_the_distance():
    r = random.Random(14)
    pairs = []
    for _ in range(400):
        a = bytes(r.choice(b"abcdefgh XYZ019") for _ in range(r.randrange(24, 900)))
        pairs.append((a, changed(r, a, r.randrange(0, 9))))
    data = np.frombuffer(b"".join(x for p in pairs for x in p), np.uint8)
    end = np.cumsum([len(x) for p in pairs for x in p])
    counts = line_dedup.byte_counts(data, np.r_[0, end[:-1]], end)
    low = line_dedup.counts_apart(counts[::2], counts[1::2])
    for (a, b), n in zip(pairs, low.tolist(), strict=True):
        assert n <= max(len(a), len(b)) and (len(a) > 200 or n <= distance(a, b))
    assert low.max() > 3


def test_near_lines_meet_once():
    """Lines within the budget have one meeting, however many keys they share; its probes are those that an alignment allows."""
    r = random.Random(15)
    for n in (147, 150, 199, 203, 349, 700, 1499, 2499, 2600):
        for _ in range(6):
            a = bytes(r.choice(b"abcdefgh ") for _ in range(n))
            b = changed(r, a, n // 50)
            near = line_dedup.within_far(a, b, line_dedup.budget(max(len(a), len(b))))
            batch = pa.RecordBatch.from_arrays([pa.array([a.decode(), b.decode()])], names=["text"])
            keys = list(line_dedup._packed_keys(iter([batch]), 2, 50, 24, 7))
            met = [m for t in line_dedup._meet(iter(keys), 2, 50) for m in t.to_pylist()]
            assert len({m["h1"] for m in met}) == len(met) == (2 if a != b else 0) or not near and not met
            rows = sum(x for t in keys for x in t.column("rows").to_pylist())
            assert n > 700 or rows < 2 * (len(a) + len(b)) / line_dedup.GRAM
