import random

from pyspark.sql import functions as F

from graphloom.llm.decontaminate import best_end, budget, leaks


def slow_best(pattern, text):
    row = [0] * (len(text) + 1)
    for p in pattern:
        new = [row[0] + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def whole_distance(pattern, text):
    row = list(range(len(text) + 1))
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_distance_by_brute_force():
    r = random.Random(5)
    for _ in range(300):
        p = [r.randrange(4) for _ in range(r.randrange(1, 90))]
        t = [r.randrange(4) for _ in range(r.randrange(0, 60))]
        d = slow_best(p, t)
        got = best_end(p, t, len(p))
        assert (got[0] if got else len(p)) == min(d, len(p))


def test_planted_passages(spark):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(2, 60)))) for i in range(30)] + [(30, None), (31, "")]
    docs = []
    for d in range(120):
        ws = [r.choice(vocab) for _ in range(r.randrange(0, 200))]
        if d % 3 == 0:
            item = items[r.randrange(30)][1].split()
            for _ in range(r.randrange(0, 9)):
                k = r.randrange(len(item))
                kind = r.randrange(3)
                item[k : k + 1] = [[], ["edit"], [item[k], "more"]][kind]
                item = item or ["x"]
            at = r.randrange(len(ws) + 1)
            ws[at:at] = item
        docs.append((d, " ".join(ws).upper().replace(" ", ", ", 3)))
    docs += [(500, None), (501, ""), (502, "one"), (None, items[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = {}
    for d, text in docs:
        ws = (text or "").lower().replace(",", "").split()
        for i, item in items:
            p = (item or "").split()
            if p and (dist := slow_best(p, ws)) <= budget(len(p)):
                want[d, i] = dist
    assert len(want) >= 20
    for block in (8 << 20, 200):
        got = leaks(frame, bench, block).collect()
        assert {(x.doc_id, x.item_id): x.distance for x in got} == want
        assert len(got) == len(want)
        words = {d: (t or "").lower().replace(",", "").split() for d, t in docs}
        for x in got:  # the passage itself is at that distance, end to end
            assert whole_distance(dict(items)[x.item_id].split(), words[x.doc_id][x.word_start : x.word_end]) == x.distance
    assert leaks(frame, bench.limit(0)).count() == 0 == leaks(frame.limit(0), bench).count()
