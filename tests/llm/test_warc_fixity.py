import hashlib

from pyspark.sql import functions as F

from graphloom.llm.warc_fixity import audit, damaged, layout, mismatches, tree

SCHEMA = "page_id long, url string, html string"


def record(i, url, html):
    url, html = url or "", html or ""
    n = len(html.encode())
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {n}\r\n\r\n{html}\r\n\r\n".encode()


def brute(a, b):
    def placed(rows):
        out, at, seen = {}, {}, {}
        for i, raw in sorted(((r[0], record(*r)) for r in rows if r[0] is not None), key=lambda x: (x[0], hashlib.sha256(x[1]).hexdigest())):
            f = i // 4096
            k = seen[i] = seen.get(i, -1) + 1
            out[i, k] = (at.get(f, 0), len(raw), hashlib.sha256(raw).hexdigest())
            at[f] = at.get(f, 0) + len(raw)
        return out

    x, y = placed(a), placed(b)
    got, shift = {}, {}
    for k in sorted(x.keys() | y.keys()):
        p, q = x.get(k), y.get(k)
        state = "missing" if q is None else "extra" if p is None else "changed" if p[2] != q[2] else None
        if state:
            f = k[0] // 4096
            shift[f] = shift.get(f, 0) + (q[1] if q else 0) - (p[1] if p else 0)
            got[k] = (state, *(p or (None,) * 3), *(q or (None,) * 3), shift[f])
        elif p[0] != q[0]:  # displaced by what the last row of its file says
            assert q[0] - p[0] == shift[k[0] // 4096]
    return got


def test_audit_by_brute_force(spark):
    a = [(i * 37, f"http://x/{i}", f"<p>é{i}</p>" * (i % 5)) for i in range(400)] + [(5, None, None), (5, "u", None), (5, "u", None), (None, "u", "h"), (-3, "n", "n")]
    b = [r for r in a if r[0] != 37 * 11] + [(10_001, "new", "new")]
    b[17] = (b[17][0], b[17][1], "changed")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).withColumn("level", F.lit("clash"))
    got = {(r.record_id, r.copy): tuple(r)[2:] for r in audit(frame(a), frame(b)).collect()}
    assert got == brute(a, b) and {v[0] for v in got.values()} == {"missing", "extra", "changed"}
    assert len(got) == 3  # one lost record displaces the others without a row each
    assert audit(frame(a), frame(a)).count() == 0
    assert audit(frame(a).limit(0), frame(a).limit(0)).count() == 0
    assert audit(frame(a), frame(a).limit(0)).where("state <> 'missing'").count() == 0


def test_descent_stays_in_differing_branches(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    one, two = tree(layout(pages)), tree(layout(pages.where("page_id <> 40")))
    assert mismatches(one, two).agg(F.min("node")).first()[0] == 40
    assert mismatches(one, one).count() == 0
    assert damaged(pages.union(spark.createDataFrame([(None, None, None), (7, "", "")], SCHEMA))).count() == pages.count() + 2


def test_query_matches_sql(spark, small):
    import duckdb

    from graphloom.llm.oracles import ORACLES
    from graphloom.llm.queries import QUERIES

    db = duckdb.connect()
    for t in ("pages", "embeddings"):
        db.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    for name in ("op4_warc_fixity", "op5_embedding_dedup"):
        got = QUERIES[name](spark, small)
        want = db.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
