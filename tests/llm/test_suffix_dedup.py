import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm.suffix_dedup import repeated_bytes


def brute(rows, length):
    least = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                least[w] = min(d, least.get(w, d))
    out = []
    for d, b in raw:
        off = [False] * len(b)
        for i in range(len(b) - length + 1):
            if d is not None and least[b[i : i + length]] < d:
                off[i : i + length] = [True] * length
        kept = bytes(x for x, o in zip(b, off, strict=True) if not o)
        spans = sum(o and (i == 0 or not off[i - 1]) for i, o in enumerate(off))
        out.append((d, len(b), sum(off), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def sample():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    vocab = [word() for _ in range(300)]
    passages = [" ".join(r.choice(vocab) for _ in range(r.randrange(5, 40))) for _ in range(12)]
    rows = []
    for d in range(150):
        parts = []
        for _ in range(r.randrange(0, 6)):
            parts.append(r.choice(passages)[r.randrange(0, 30) :] if r.random() < 0.4 else " ".join(r.choice(vocab) for _ in range(r.randrange(1, 50))))
        rows.append((d * 3 % 150, "".join(parts)))
    rows += [(200 + i, rows[5][1] + "x" * 60) for i in range(5)] + [(300, "x" * 500), (301, "y" * 49), (302, "y" * 50), (303, "y" * 51)]
    rows += [(400, None), (401, ""), (402, "z"), (None, rows[5][1] + "q" * 80), (403, "q" * 80), (300, "x" * 500), (300, passages[0] * 2), (404, "ab" * 700), (405, "ab" * 900), (300, "two texts of one id " * 9), (406, "two texts of one id " * 9)]
    return rows


@pytest.mark.parametrize("length", [50, 33])
def test_against_brute_force(spark, length):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("rid", F.lit(1)).withColumn("tag", F.lit(1)).withColumn("n_removed", F.lit(2)).withColumn("sha", F.lit("x"))
    got = sorted((tuple(r) for r in repeated_bytes(docs, length).collect()), key=str)
    want = brute(rows, length)
    assert sum(w[2] for w in want) > 5000
    assert got == want


def judged_plainly(rows):
    """(decided, open) of rows (name, around, doc)."""
    decided = [any(x[0] == g and x[1] == a and x[2] < d for x in rows) for g, a, d in rows]
    several = [len({x[1] for x in rows if x[0] == g}) > 1 and len({x[2] for x in rows if x[0] == g}) > 1 for g, _, _ in rows]
    return decided, [s and not y for s, y in zip(several, decided, strict=True)]


def test_judging_and_combining(monkeypatch):
    import numpy as np

    from graphloom.llm import packed, suffix_dedup
    from graphloom.llm.suffix_dedup import _combined, _judged

    r = np.random.default_rng(1)
    for _ in range(60):
        n = int(r.integers(1, 60))
        cols = r.integers(0, 5, n).astype(np.uint64), r.integers(0, 3, n).astype(np.uint64), r.integers(0, 4, n)
        rows = list(zip(*(c.tolist() for c in cols), strict=True))
        decided, open_ = _judged(*cols)
        assert (decided.tolist(), open_.tolist()) == judged_plainly(rows)
        # Combined in two tasks and then judged, each row is decided, open or left as before, or open more often.
        monkeypatch.setattr(suffix_dedup, "WITNESSES", int(r.integers(1, 4)))
        half = int(r.integers(0, n + 1))
        kind = np.concatenate([_combined(*(c[:half] for c in cols)), _combined(*(c[half:] for c in cols))])
        sent = np.flatnonzero(kind == 0)
        d, o = _judged(*(c[sent] for c in cols))
        got_decided, got_open = kind == 1, kind == 2
        got_decided[sent[d]] = True
        got_open[sent[o]] = True
        for i in range(n):
            assert not got_decided[i] or decided[i]
            assert not decided[i] or got_decided[i] or got_open[i]
            could_go = open_[i] and any(x[0] == rows[i][0] and x[2] < rows[i][2] for x in rows)
            assert not could_go or got_open[i], (rows, i)
        blocks = list(packed.pack([cols[0], cols[2]], 7))
        for held in (1, 1000):
            back = [x for part in packed.gather(iter(blocks), (np.uint64, np.int64), held) for x in zip(part[0].tolist(), part[1].tolist(), strict=True)]
            assert sorted(back) == sorted((g, d) for g, _, d in rows)


def test_rounds_by_brute_force(spark):
    """Each round's ranks against the strings themselves."""
    from graphloom.llm.suffix_dedup import STEPS, refine

    r = random.Random(3)
    text = {d: "".join(r.choice("ab") for _ in range(30)) + "M" * 24 + "".join(r.choice("ab") for _ in range(30)) for d in range(40)}
    for d in range(20, 40):  # copies of parts
        text[d] = text[d - 20][: r.randrange(20, 70)].ljust(84, "c") if r.random() < 0.8 else text[d]
    rows = [(0, d, 0, 4, 26, text[d][4 : 4 + 76].encode()) for d in text]
    runs, before, gone = spark.createDataFrame(rows, "rank long, doc long, tag int, start long, behind int, bytes binary"), 0, set()
    for step in STEPS:
        level = refine(runs, step, before, 50).collect()
        by_rank = {}
        for x in level:
            p, lo = x.start + x.behind, x.behind // step * step
            by_rank.setdefault(x["rank"], set()).add((lo, text[x.doc][p - lo : p + 51 - min(lo + step, 27)]))
            if not x.open:
                gone |= {(x.doc, x.start + i) for i in range(x.windows)}
        assert all(len(v) == 1 for v in by_rank.values()) and len({next(iter(v)) for v in by_rank.values()}) == len(by_rank)
        runs, before = spark.createDataFrame([x for x in level if x.open], "doc long, tag int, start long, windows int, open boolean, rank long, behind int, bytes binary"), step
    # 27 windows hold the minimizer at 30; a window goes if a smaller document has it there.
    want = {(d, s) for d in text for s in range(4, 31) if any(e < d and text[e][s : s + 50] == text[d][s : s + 50] for e in text)}
    assert want and gone == want and runs.count() == 0


def test_whole_table_and_empty(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in repeated_bytes(docs).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()], 50)
    assert repeated_bytes(docs.limit(0)).count() == 0
