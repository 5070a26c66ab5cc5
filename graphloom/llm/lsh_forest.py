"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

Each text is its set of five-word shingles. Texts with equal sets collapse into one class.
A class has one label of ``DEPTH`` min-hashes in each of ``TREES`` prefix tries. Spark sorts
the labels of each trie, so that the longest prefix an entry shares with any other is the
one it shares with a neighbour. Matches start at whole labels. Pairs that share a prefix of
that length in some trie are verified exactly on the shingle sets; their similarities tell
how many pairs at or above the threshold the length finds (a pair of similarity s shares d
min-hashes in one of t tries with probability ``1 - (1 - s**d)**t``). Until that reaches the
target recall, the prefixes are shortened by one level, and the pairs that meet for the
first time are verified. At the length that finds the least similar pairs with the target
recall, it ends in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import U64, Unions, fold, grams, mix, text_slices, words
from .storage import discard, materialize

SHINGLE = 5
TREES = 20
DEPTH = 7
RECALL = 0.9995
#: Where the measured recall ends the search, a pair at the threshold itself is found with this probability at least.
LEAST_RECALL = 0.99
#: Bits kept of each min-hash; four make one word of a label.
BITS = 16
#: Members of a node that meet in one task; larger nodes are cut into blocks that meet two by two.
BLOCK = 400
#: Shingles of the members of one block.
BLOCK_SHINGLES = 400_000


def found_share(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that a pair shares ``depth`` min-hashes in one of the tries."""
    return 1 - (1 - similarity**depth) ** trees


def stop_depth(threshold: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The deepest level at which a pair at the threshold shares a prefix with at least the target recall."""
    return next((d for d in range(depth, 1, -1) if found_share(threshold, d, trees) >= recall), 1)


def estimated_recall(found: dict[int, int], depth: int, trees: int = TREES) -> float:
    """Share of the pairs at or above the threshold that ``depth`` has found, from the pairs found by thousandths of similarity."""
    total = sum(n / found_share(max(s, 1) / 1000, depth, trees) for s, n in found.items())
    return sum(found.values()) / total if total else 1.0


def masks(depth: int) -> tuple[int, int]:
    """The bits of both words of a label that hold its first ``depth`` min-hashes, as signed longs."""
    bits = ((1 << BITS * depth) - 1) << (128 - BITS * depth)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(bits >> 64), signed(bits & ((1 << 64) - 1))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row: runs of five words, or all the words of a row with one to four."""
    for _, offsets, data in text_slices(column):
        h, _, first = words(*fold(offsets, data))
        g, starts = grams(h, first, SHINGLE)
        for i in range(len(offsets) - 1):
            x = g[starts[i] : starts[i + 1]]
            if not len(x) and first[i + 1] > first[i]:
                x = h[first[i] : first[i] + 1].copy()
                for w in h[first[i] + 1 : first[i + 1]]:
                    x = mix(x * U64(31) + w)
            yield np.unique(x)


class Hashing:
    def __init__(self, trees: int, depth: int):
        r = np.random.default_rng(11)
        self.xor = r.integers(0, 2**63, trees * depth, dtype=np.int64).astype(U64)
        self.mul = r.integers(0, 2**63, trees * depth, dtype=np.int64).astype(U64) * U64(2) + U64(1)
        self.trees, self.depth = trees, depth

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Two words a trie: the label's min-hashes from the highest bits on."""
        v = np.empty(self.trees * self.depth, U64)
        for a in range(0, len(x), 4096):
            part = ((x[a : a + 4096, None] ^ self.xor) * self.mul).min(axis=0)
            v = part if a == 0 else np.minimum(v, part)
        v = mix(v.reshape(self.trees, self.depth)) >> U64(64 - BITS)
        out = np.zeros((self.trees, 2), U64)
        for d in range(self.depth):
            out[:, d // 4] |= v[:, d] << U64(BITS * (3 - d % 4))
        return out.ravel()


def content_names(x: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit names of a shingle set."""
    return int(np.bitwise_xor.reduce(mix(x))), int(mix(x * U64(0xA24BAED4963EE407)).sum())


def _signatures(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing(TREES, DEPTH)
        for batch in batches:
            n, names, labels = [], [], []
            for x in shingle_sets(batch.column(1)):
                n.append(len(x))
                names.append(content_names(x) if len(x) else (0, 0))
                labels.append(hashing.labels(x) if len(x) else np.zeros(2 * TREES, U64))
            flat = np.concatenate(labels).view(np.int64) if labels else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * TREES, dtype=np.int32)), pa.array(flat))
            k1, k2 = (pa.array(np.array([k[i] for k in names], U64).view(np.int64)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), k1, k2, lists], names=["doc_id", "n", "k1", "k2", "labels"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n int, k1 long, k2 long, labels array<long>")


def _prefix(labels: np.ndarray, depth: int) -> np.ndarray:
    return labels.reshape(len(labels), TREES, 2) & np.array(masks(depth), np.int64)


def _first_meeting(labels: np.ndarray, left: np.ndarray, right: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """Mask of left x right: pairs that share no longer prefix anywhere, and none of this length in a trie before ``tree``."""
    fresh = np.ones((len(left), len(right)), bool)

    def leave(p: np.ndarray, trees: int) -> None:
        for t in range(trees):
            np.logical_and(fresh, (p[left, t, 0][:, None] != p[right, t, 0]) | (p[left, t, 1][:, None] != p[right, t, 1]), out=fresh)

    leave(_prefix(labels, depth), tree)
    if depth < DEPTH:
        leave(_prefix(labels, depth + 1), TREES)
    return fresh


def _meetings(side: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    if same:
        both = np.arange(len(side))
        return both, both
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """The groups of rows with equal leading ``columns``, from sorted batches."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(c)[i].as_py() for c in range(columns))

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in range(columns):
            x = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for i in np.flatnonzero(change).tolist():
            held.append(batch.slice(at, i - at))
            yield pa.Table.from_batches(held)
            held, at = [], i
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _need(batches: Iterator[pa.RecordBatch], threshold: float, depth: int) -> Iterator[pa.RecordBatch]:
    """Members that have a pair to verify in their meeting: rows of ``tree, hi, lo, i, j, side, cls, n, labels``, sorted."""
    for t in _runs(batches, 5):
        if t.num_rows < 2:
            continue
        tree, side, n = t.column("tree")[0].as_py(), t.column("side").to_numpy(), t.column("n").to_numpy().astype(np.float64)
        labels = t.column("labels").combine_chunks().flatten().to_numpy().reshape(-1, 2 * TREES)
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        left, right = _meetings(side, same)
        if not len(left) or not len(right):
            continue
        ok = _first_meeting(labels, left, right, tree, depth)
        ok &= np.minimum(n[left][:, None], n[right][None, :]) >= threshold * np.maximum(n[left][:, None], n[right][None, :]) - 1e-9
        if same:
            np.fill_diagonal(ok, False)
        some = np.zeros(t.num_rows, bool)
        some[left[ok.any(axis=1)]] = True
        some[right[ok.any(axis=0)]] = True
        if some.any():
            yield from t.filter(pa.array(some)).combine_chunks().to_batches()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every two sets, by products over the shingles that at least two of them hold."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.r_[True, flat[1:] != flat[:-1]]
    col = np.cumsum(first) - 1
    df = np.bincount(col)
    keep = df[col] > 1
    row, col = row[keep], (np.cumsum(df > 1) - 1)[col[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    total = int(col[-1]) + 1 if len(col) else 0
    for a in range(0, total, 4096):
        lo, hi = np.searchsorted(col, [a, a + 4096])
        x = np.zeros((len(sets), min(4096, total - a)), np.float32)
        x[row[lo:hi], col[lo:hi] - a] = 1
        out += x @ x.T
    return out


def _verify(batches: Iterator[pa.RecordBatch], threshold: float, depth: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``tree, hi, lo, i, j, side, cls, copies, labels, set``, sorted, to ``kind, a, b``: linked copies, links of a spanning forest, and pairs by thousandths of similarity."""
    for t in _runs(batches, 5):
        if t.num_rows < 2:
            continue
        cls = t.column("cls").to_numpy()
        if (cls[1:] == cls[:-1]).any():  # repeated rows of a representative
            t = t.filter(pa.array(np.r_[True, cls[1:] != cls[:-1]]))
            cls = t.column("cls").to_numpy()
        tree, side = t.column("tree")[0].as_py(), t.column("side").to_numpy()
        copies = t.column("copies").to_numpy()
        labels = t.column("labels").combine_chunks().flatten().to_numpy().reshape(-1, 2 * TREES)
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        left, right = _meetings(side, same)
        if not len(left) or not len(right):
            continue
        sets = [np.frombuffer(s.as_py(), U64) for s in t.column("set")]
        size = np.array([len(s) for s in sets], np.float64)
        both = _overlaps(sets)[np.ix_(left, right)].astype(np.float64)
        # Counts are whole numbers, so the comparison is exact up to the rounding of the threshold.
        union = size[left][:, None] + size[right][None, :] - both
        ok = both >= threshold * union - 1e-9
        ok &= _first_meeting(labels, left, right, tree, depth)
        if same:
            ok &= np.triu(np.ones_like(ok), 1)
        p, q = np.nonzero(ok)
        if not len(p):
            continue
        near = np.bincount((1000 * both[p, q] / union[p, q]).astype(np.int64))
        p, q = left[p], right[q]
        linked, sets_ = np.zeros(len(cls), np.int64), Unions(len(cls))
        np.add.at(linked, p, copies[q])
        np.add.at(linked, q, copies[p])
        edges = [(x, y) for x, y in zip(p.tolist(), q.tolist(), strict=True) if sets_.join(x, y)]
        some, bins = np.flatnonzero(linked), np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([0, 1, 2], np.int8), [len(some), len(edges), len(bins)])),
                pa.array(np.r_[cls[some], cls[[x for x, _ in edges]], bins]),
                pa.array(np.r_[linked[some], cls[[y for _, y in edges]], near[bins]]),
            ],
            names=["kind", "a", "b"],
        )


def tries(classes: DataFrame, depth: int) -> DataFrame:
    """``tree, hi, lo, cls, n, deep``: the sorted labels of all tries, without entries that share no prefix of ``depth``.

    ``deep`` is the longest prefix that an entry shares with another one. In the sorted
    order, that is a neighbour.
    """
    high, low = masks(depth)
    label = F.posexplode(F.expr(f"transform(sequence(0, {TREES - 1}), t -> named_struct('hi', labels[2 * t], 'lo', labels[2 * t + 1]))"))
    t = classes.select(F.col("k1").alias("cls"), "n", label.alias("tree", "label")).select("tree", "label.hi", "label.lo", "cls", "n")
    t = t.withColumn("_hi", F.col("hi").bitwiseAND(F.lit(high))).withColumn("_lo", F.col("lo").bitwiseAND(F.lit(low)))
    node = Window.partitionBy("tree", "_hi", "_lo").orderBy("hi", "lo", "cls")
    shared = lambda side: F.expr("case " + " ".join(f"when hi & {masks(d)[0]}L = {side}_h & {masks(d)[0]}L and lo & {masks(d)[1]}L = {side}_l & {masks(d)[1]}L then {d}" for d in range(DEPTH, depth - 1, -1)) + " else 0 end")
    t = t.select("*", F.lag("hi").over(node).alias("p_h"), F.lag("lo").over(node).alias("p_l"), F.lead("hi").over(node).alias("q_h"), F.lead("lo").over(node).alias("q_l"))
    t = t.select("tree", "hi", "lo", "cls", "n", F.greatest(shared("p"), shared("q")).alias("deep"))
    return t.where("deep > 0")


def _level(entries: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float, depth: int) -> DataFrame:
    """Links of pairs whose longest shared prefix in any trie is ``depth`` long."""
    high, low = masks(depth)
    members = entries.where(F.col("deep") >= depth).select("tree", F.col("hi").bitwiseAND(F.lit(high)).alias("hi"), F.col("lo").bitwiseAND(F.lit(low)).alias("lo"), "cls", "n")
    size = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)))
    nodes = members.groupBy("tree", "hi", "lo").agg(size.cast("int").alias("blocks"))
    members = members.join(nodes, ["tree", "hi", "lo"]).select("cls", F.struct("tree", "hi", "lo", "blocks").alias("at"))
    members = members.join(classes.select(F.col("k1").alias("cls"), "n", "labels"), "cls")
    members = members.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("at.blocks")).cast("int"))
    meets = F.expr("transform(sequence(0, at.blocks - 1), o -> named_struct('i', least(o, own), 'j', greatest(o, own), 'side', if(own <= o, 0, 1)))")
    members = members.select("at.tree", "at.hi", "at.lo", F.explode(meets).alias("m"), "cls", "n", "labels")
    members = members.select("tree", "hi", "lo", "m.i", "m.j", "m.side", "cls", "n", "labels")
    place = ["tree", "hi", "lo", "i", "j"]
    dealt = members.repartition(*place).sortWithinPartitions(*place)
    need = dealt.mapInArrow(lambda b: _need(b, threshold, depth), "tree int, hi long, lo long, i int, j int, side int, cls long, n int, labels array<long>")
    need = materialize(need, "need")
    wanted = need.groupBy("cls").agg(F.collect_list(F.struct(*place, "side")).alias("at"), F.first("labels").alias("labels"))
    wanted = wanted.join(classes.select(F.col("k1").alias("cls"), "rep", "copies"), "cls")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.withColumn("rep", F.col("rep").cast("long")), "rep")

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0)))
            # Another text of the same id isn't the class's.
            own = batch.column(1).to_numpy().view(U64)
            mine = np.flatnonzero([bool(len(s)) and content_names(s)[0] == int(k) for s, k in zip(sets, own, strict=True)])
            for a in range(0, len(mine), 500):
                rows = mine[a : a + 500]
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([sets[i].tobytes() for i in rows.tolist()], pa.binary())], names=["cls", "at", "labels", "copies", "set"])

    kind = "cls long, at array<struct<tree:int,hi:long,lo:long,i:int,j:int,side:int>>, labels array<long>, copies long, set binary"
    full = texts.select("text", "cls", "at", "labels", "copies").mapInArrow(attach, kind)
    full = full.select(F.explode("at").alias("m"), "cls", "copies", "labels", "set").select("m.tree", "m.hi", "m.lo", "m.i", "m.j", "m.side", "cls", "copies", "labels", "set")
    full = full.repartition(*place).sortWithinPartitions(*place, "cls")
    links = materialize(full.mapInArrow(lambda b: _verify(b, threshold, depth), "kind byte, a long, b long"), "links")
    discard(need)
    return links


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, n_links, component_id, kept``.

    Documents link when the Jaccard similarity of their shingle sets is at least
    ``threshold``; those with equal sets are copies and link too. ``n_links`` counts the
    other documents linked directly, ``component_id`` is the smallest doc_id reachable and
    ``kept`` holds for that document. Texts that are null or without words link with
    nothing. A row with a null doc_id gets no links, a null component and stays kept.
    Repeated rows of an id count as copies; different texts of one id are two members, each
    with its own links and component. Words, sets and classes are named by 64-bit hashes,
    classes by two of them. A text is held whole by one task.
    """
    base = stop_depth(threshold, recall)
    sig = materialize(_signatures(docs), "signatures")
    good = sig.where("n > 0 and doc_id is not null")
    classes = good.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    classes = materialize(classes, "classes")
    entries = materialize(tries(classes, base), "tries")
    links, found = None, {}
    for depth in range(DEPTH, base - 1, -1):
        level = _level(entries, classes, docs, threshold, depth)
        links = level if links is None else links.unionByName(level)
        for s, n in level.where("kind = 2").groupBy("a").agg(F.sum("b")).collect():  # a row for each thousandth at most
            found[s] = found.get(s, 0) + n
        if estimated_recall(found, depth) >= recall and found_share(threshold, depth) >= LEAST_RECALL:
            break
    linked = links.where("kind = 0").groupBy(F.col("a").alias("k1")).agg(F.sum("b").alias("linked"))
    comp = connected_components(links.where("kind = 1"), "a", "b").withColumnRenamed("node", "k1")
    result = classes.select("k1", "k2", "rep", "copies").join(linked, "k1", "left").join(comp, "k1", "left")
    least = result.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    result = result.join(least, "component", "left").where("copies > 1 or linked is not null")
    result = result.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    # Rows that link with nothing are dealt by their id, not all by the null of a missing class.
    alone = F.expr("n = 0 or doc_id is null")
    out = sig.select("doc_id", "n", F.when(alone, F.xxhash64("doc_id", F.lit(3))).otherwise(F.col("k1")).alias("k1"), F.when(alone, F.lit(None)).otherwise(F.col("k2")).alias("k2")).join(result, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
