"""WARC fixity audit: Merkle trees over records and ordered offset ranges.

A replica's records are laid out in files. The leaf of a record hashes its length and its
content. Every level above hashes ``FANOUT`` ordered neighbours, together with the offset
ranges they cover in their parent, up to one root a file that covers the whole file. An
audit compares the roots of two replicas and goes down only where hashes differ, from
level to level, until it reaches the records. Offsets count from a node's start, so that
a record that is lost or cut short leaves the branches behind it equal; how far it
displaces them is told once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

FANOUT = 16
#: Records of a file at most; files are numbered by the record's id, so each one is a bounded window.
FILE_RECORDS = 4096
LEVELS = 3  # FANOUT ** LEVELS = FILE_RECORDS


def layout(records: DataFrame) -> DataFrame:
    """WARC records of pages: ``file, slot, record_id, start, length, sha256`` with their offsets in each file.

    ``records`` has ``page_id, url, html``. File and slot come from the id, ``start`` is the
    running sum of the lengths before it in the file. A null url or html counts as empty.
    Repeated ids follow one another by content; rows with a null id can't be placed and are
    left out of the layout.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    body = F.octet_length(html)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), body.cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head, html, F.lit("\r\n\r\n"))
    r = records.where("page_id is not null").select(F.col("page_id").cast("long").alias("record_id"), F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("sha256"))
    r = r.withColumn("file", F.floor(F.col("record_id") / FILE_RECORDS).cast("long"))
    order = Window.partitionBy("file").orderBy("record_id", "sha256")
    r = r.withColumn("start", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length"))
    copy = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("sha256")) - 1
    return r.select("file", (F.col("record_id") - F.col("file") * FILE_RECORDS).cast("int").alias("slot"), copy.alias("copy"), "record_id", "start", "length", "sha256")


def tree(placed: DataFrame) -> DataFrame:
    """Every node of every file's tree: ``file, level, node, start, stop, hash``; level 0 is the slots, the top is node 0."""
    leaf = F.sha2(F.concat_ws("|", "length", "sha256"), 256)
    # Repeated ids share a slot: its hash covers all of them in order.
    per = placed.withColumn("leaf", leaf).groupBy("file", F.col("slot").alias("node")).agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("copy", "leaf"))).alias("parts"))
    level = per.select("file", F.lit(0).alias("level"), "node", "start", "stop", F.sha2(F.concat_ws("|", F.col("parts.leaf")), 256).alias("hash"))
    out = level
    for k in range(1, LEVELS + 1):
        up = level.groupBy("file", F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.sort_array(F.collect_list(F.struct(F.col("node").alias("child"), F.col("start").alias("from"), F.col("stop").alias("to"), "hash"))).alias("parts"))
        text = F.concat_ws("|", F.transform("parts", lambda p: F.concat_ws(":", p["child"], p["from"] - F.col("start"), p["to"] - F.col("start"), p["hash"])))
        level = up.select("file", F.lit(k).alias("level"), "node", "start", "stop", F.sha2(text, 256).alias("hash"))
        out = out.unionByName(level)
    return out


def mismatches(one: DataFrame, two: DataFrame) -> DataFrame:
    """Slots whose hashes differ between two trees: ``file, node``, found from the roots downwards.

    Each level looks only at the children of the branches that differ above it.
    """
    at = None
    for k in range(LEVELS, -1, -1):
        a = one.where(F.col("level") == k).select("file", "node", F.col("hash").alias("a"))
        b = two.where(F.col("level") == k).select("file", "node", F.col("hash").alias("b"))
        if at is not None:
            up = at.select("file", F.col("node").alias("up"))
            a = a.withColumn("up", F.floor(F.col("node") / FANOUT).cast("int")).join(up, ["file", "up"], "left_semi").drop("up")
            b = b.withColumn("up", F.floor(F.col("node") / FANOUT).cast("int")).join(up, ["file", "up"], "left_semi").drop("up")
        at = a.join(b, ["file", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")
    return at


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """What differs between two replicas: ``record_id, copy, state, offset_a, length_a, sha256_a, offset_b, length_b, sha256_b, shift``.

    ``state`` is ``missing`` (only in the first), ``extra`` (only in the second) or
    ``changed`` (other content). ``shift`` tells by how many bytes the records behind this
    one, up to the next row of its file, are displaced in the second replica. Copies of a
    repeated id are aligned in the order of their contents. Equal replicas give no row. A
    file's window holds all copies of its ids.
    """
    a, b = materialize(layout(first), "replica"), materialize(layout(second), "replica")
    ta, tb = materialize(tree(a), "tree"), materialize(tree(b), "tree")
    bad = materialize(mismatches(ta, tb), "mismatches").select("file", F.col("node").alias("slot"))
    cols = lambda df, s: df.join(bad, ["file", "slot"], "left_semi").select("file", "record_id", "copy", F.col("start").alias(f"offset_{s}"), F.col("length").alias(f"length_{s}"), F.col("sha256").alias(f"sha256_{s}"))
    both = cols(a, "a").join(cols(b, "b"), ["file", "record_id", "copy"], "full")
    state = F.when(F.col("sha256_b").isNull(), "missing").when(F.col("sha256_a").isNull(), "extra").when(F.col("sha256_a") != F.col("sha256_b"), "changed")
    both = both.withColumn("state", state).where("state is not null")
    grown = F.coalesce("length_b", F.lit(0)) - F.coalesce("length_a", F.lit(0))
    behind = Window.partitionBy("file").orderBy("record_id", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("shift", F.sum(grown).over(behind)).select("record_id", "copy", "state", "offset_a", "length_a", "sha256_a", "offset_b", "length_b", "sha256_b", "shift")


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica of ``pages`` with known damage, for drills: one byte of some records changed, some cut short, some lost.

    Which ones follows from the id: of a thousand ids, the ones ending in 007, 407 and 807
    get an ``x`` in place of their first character, those ending in 123 lose their last
    character and those ending in 661 are lost.
    """
    tail = F.pmod(F.col("page_id"), F.lit(1000))
    html = (
        F.when(tail.isin(7, 407, 807), F.concat(F.lit("x"), F.substring("html", 2, 1 << 30)))
        .when(tail == 123, F.expr("left(html, greatest(length(html) - 1, 0))")).otherwise(F.col("html"))
    )
    return pages.where(F.coalesce(tail != 661, F.lit(True))).select("page_id", "url", html.alias("html"))
