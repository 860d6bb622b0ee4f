"""Near-duplicate texts by one-permutation MinHash with optimal densification (operator 3).

1. Each text gives its set's size, a 128-bit digest of the set, and band keys: the 64-bit hash range is cut into
   bands x ROWS bins, the least hash of each bin is its value, an empty bin borrows from the first non-empty one of a
   fixed random sequence of bins (so that borrowing agrees between similar sets), and ROWS bins make a band's key.
   Texts of one set are one class from there on.
2. In each band bucket the smallest class is the centre; the distinct (member, centre) edges are the candidates, at
   most one for each class and band whatever a bucket's size. Two members of a bucket share its centre, so all
   candidate pairs meet in the centre's cell.
3. A cell's texts are brought together, CHUNK at most at once and the centre with each chunk, and compared on their
   full sets: the centre with all others, then each text that is still apart with what it is not yet linked to. A cell
   of true copies thus costs one comparison a member; no pair of two unlinked members goes uncompared.
4. Only where a cell has several chunks and more than one component remains do chunks meet in pairs, without the
   members whose distance from the centre proves (by the triangle inequality of the Jaccard distance) that no
   member of another component can reach them.
5. Connected components of the confirmed links; each row gets its class's component.

Exact copies, however many, meet their class by a salted join, and so do a centre's links; texts are fetched for members
of cells only, and the ids of those are broadcast only up to BROADCAST of them.

Defined cases: null, empty and blank texts have n_shingles 0 and link with nothing; a null doc_id comes back with its
size, without component and kept; rows of equal doc_id are one node, and each comes back (the centre of a cell then is
the same one of its texts in every chunk); very long texts are hashed block by block and whole; equal similarities
need no order, as only components count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import Scratch, release, salted_join, small, tune
from .hashing import bounded, mix, shingle_sets

ROWS = 6
#: Chance that two texts exactly as similar as asked share no band; more similar ones share one more surely.
MISSED = 3e-5
#: Members of a cell that one task compares at once, and shingles of all of them together.
CHUNK, CHUNK_SHINGLES = 1024, 1_000_000
#: Ids that are broadcast; more of them are joined by shuffling.
BROADCAST = 1_000_000
_U = np.uint64


class OnePermutation:
    """Signatures and band keys of sets of 64-bit hashes."""

    def __init__(self, rows: int, bands: int):
        self.rows, self.bands, self.bins = rows, bands, rows * bands
        random = np.random.default_rng(7)
        self.borrow = random.integers(0, self.bins, size=(4096, self.bins))
        self.weights = random.integers(1, 2**63, size=rows, dtype=np.uint64) * _U(2) + _U(1)
        self.salt = random.integers(1, 2**63, size=(bands, 1), dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """``hashes``: sorted, distinct, at least one."""
        bins = ((hashes >> _U(32)) * _U(self.bins)) >> _U(32)
        at = np.searchsorted(bins, np.arange(self.bins, dtype=np.uint64))
        at = np.minimum(at, len(hashes) - 1)
        full = bins[at] == np.arange(self.bins, dtype=np.uint64)
        values = hashes[at]
        empty = np.flatnonzero(~full)
        for tries in (16, 256, 4096):
            if not empty.size:
                break
            found = full[self.borrow[:tries, empty]]
            first = found.argmax(0)
            ok = found[first, np.arange(len(empty))]
            values[empty[ok]] = hashes[at[self.borrow[first[ok], empty[ok]]]]
            empty = empty[~ok]
        if empty.size:
            values[empty] = hashes[0]
        return values

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """Band keys of signatures, one row each."""
        parts = signatures.reshape(-1, self.bands, self.rows) * self.weights
        return mix(parts.sum(axis=2, dtype=np.uint64) ^ self.salt.T)


def band_count(percent: int, rows: int = ROWS) -> int:
    return int(np.ceil(np.log(MISSED) / np.log(1 - min(percent / 100, 0.99) ** rows)))


def sketches(docs: DataFrame, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest (h1, h2) and its band keys."""

    def run(batches):
        hasher = OnePermutation(rows, bands)
        for batch in batches:
            for part in bounded(batch, "text"):
                sizes, digests, signatures, filled = [], [], [], []
                for k, s in enumerate(shingle_sets(part.column("text"))):
                    sizes.append(len(s))
                    digests.append((mix(s).sum(dtype=np.uint64), mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                    if len(s):
                        filled.append(k)
                        signatures.append(hasher.signature(s))
                counts = np.zeros(len(sizes), np.int32)
                counts[filled] = bands
                keys = hasher.keys(np.stack(signatures)).reshape(-1) if filled else np.empty(0, np.uint64)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(keys.view(np.int64)))
                pairs = np.array(digests, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), lists], names=["doc_id", "n_shingles", "h1", "h2", "bands"])
        release()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def compare(ids: list, roots: list, sides: list, sets: list[np.ndarray], percent: int, centre: int | None):
    """Links (i, j) that join what is still apart, and the sizes of the centre's intersections.

    Members i and j are compared on their full sets unless they are in one component already (``roots`` has the
    components so far) or on one side (sides other than None; such pairs met elsewhere).
    """
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    flat, where = np.unique(np.concatenate(sets), return_inverse=True) if n else (np.empty(0), np.empty(0, int))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(flat), np.int32)
    links, shared = [], {}
    order = [centre, *(k for k in range(n) if k != centre)] if centre is not None else range(n)
    groups = np.array([hash(s) for s in sides])
    left = np.ones(n, bool)
    for i in order:
        left[i] = False
        own = find(roots[i])
        others = np.flatnonzero(left)
        if i != centre:
            others = others[[find(roots[j]) != own for j in others.tolist()]] if others.size else others
            if sides[i] is not None:
                others = others[groups[others] != groups[i]]
            fits = (100 * np.minimum(sizes[others], sizes[i])) >= percent * np.maximum(sizes[others], sizes[i])
            others = others[fits]
        if not others.size:
            continue
        mine = where[begin[i] : begin[i + 1]]
        mark[mine] = 1
        spans = np.concatenate([where[begin[j] : begin[j + 1]] for j in others.tolist()])
        both = np.add.reduceat(mark[spans], np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
        mark[mine] = 0
        for j, inter in zip(others.tolist(), both.tolist()):
            if i == centre:
                shared[j] = inter
            if 100 * inter >= percent * (int(sizes[i]) + int(sizes[j]) - inter) and find(roots[j]) != find(roots[i]):
                parent[find(roots[j])] = find(roots[i])
                links.append((i, j))
    return links, shared


def _cells(percent: int):
    """Python side of steps 3 and 4: rows (cell, k1, k2, node, root, side, text), groups contiguous."""
    names = ["a", "b", "shared", "size_a", "size_b", "cell"]

    def finish(rows):
        ids, roots, sides = ([r[k] for r in rows] for k in (1, 2, 3))
        sets = list(shingle_sets(pa.array([r[4] for r in rows], pa.string())))
        cell = rows[0][0][0]
        centre = next((k for k, x in enumerate(ids) if x == cell), None) if sides[0] is None else None
        links, shared = compare(ids, roots, sides, sets, percent, centre)
        if sum(map(len, sets)) > CHUNK_SHINGLES // 8:
            release()
        out = [(ids[i], ids[j], None, None, None, None) for i, j in links]
        if centre is not None and rows[0][0][1] >= 0:  # this cell has more chunks
            out += [(None, ids[j], s, len(sets[centre]), len(sets[j]), cell) for j, s in shared.items()]
        return out

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            for cell, k1, k2, node, root, side, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (cell, k1, k2) != key:
                    if len(rows) > 1:
                        out += finish(rows)
                    key, rows = (cell, k1, k2), []
                rows.append(((cell, k1, k2), node, root, side, text))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                out = []
        if len(rows) > 1:
            out += finish(rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
        rows.clear()
        release()

    return run


CONFIRMED = "a long, b long, shared long, size_a long, size_b long, cell long"


def near_duplicates(docs: DataFrame, percent: int = 85, rows: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard similarity >= percent / 100) and kept."""
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "duplicates")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = scratch.written(sketches(docs, rows, band_count(percent, rows)), "sketches")
    filled = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.written(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"), F.first("bands").alias("bands")), "classes")

    keyed = classes.select("rep", "size", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("band", "key").agg(F.min("rep").alias("cell"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    member = scratch.written(keyed.join(buckets, ["band", "key"]).filter("rep <> cell").select("cell", F.col("rep").alias("node"), "size").distinct(), "members")
    cells = member.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("size") / CHUNK_SHINGLES)).alias("chunks"))
    cells = scratch.written(cells, "cells")
    centres = cells.select("cell", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("k"))
    own = F.when(F.col("chunks") > 1, F.col("k")).otherwise(-1)
    dealt = salted_join(member.drop("size"), cells, ["cell"], "node")
    placed = dealt.select("cell", "node", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("k"))
    placed = placed.unionByName(centres.select("cell", F.col("cell").alias("node"), "chunks", "k"))
    first = placed.select("cell", own.alias("k1"), F.lit(-1).alias("k2"), "node", F.col("node").alias("root"), F.lit(None).cast("int").alias("side"))
    texts = docs.filter("doc_id IS NOT NULL")

    def confirm(dealt: DataFrame) -> DataFrame:
        dealt = scratch.written(dealt, "dealt")
        need = small(scratch.written(dealt.select(F.col("node").alias("doc_id")).distinct(), "need"), BROADCAST)
        full = dealt.join(texts.join(need, "doc_id", "left_semi").withColumnRenamed("doc_id", "node"), "node")
        full = full.select("cell", "k1", "k2", "node", "root", "side", "text").repartition("cell", "k1", "k2")
        full = full.sortWithinPartitions("cell", "k1", "k2", "node", F.xxhash64("text"))
        return scratch.written(full.mapInArrow(_cells(percent), CONFIRMED), "confirmed")

    found = confirm(first)
    links = found.filter("a IS NOT NULL").select("a", "b")
    far = found.filter("cell IS NOT NULL").select("cell", F.col("b").alias("node"), (1 - F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("far")).distinct()
    if far.limit(1).count():
        links = links.union(_across(far, cells, links, confirm, percent, scratch))

    # rows of one doc_id are one node, whatever their sets
    digest = F.struct("h1", "h2")
    repeated = filled.groupBy("doc_id").agg(F.min(digest).alias("x"), F.max(digest).alias("y")).filter("x <> y").select("doc_id")
    same = filled.join(repeated, "doc_id", "left_semi").select("doc_id", "h1", "h2").distinct()
    same = same.join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = graph.components(links.union(same), scratch)

    of_class = classes.join(joined, classes.rep == joined.node, "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    some = made.filter("n_shingles > 0").select("doc_id", "n_shingles", "h1", "h2")
    some = salted_join(some, of_class, ["h1", "h2"], "doc_id").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    out = some.unionByName(made.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return scratch.done(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _across(far: DataFrame, cells: DataFrame, links: DataFrame, confirm, percent: int, scratch: Scratch) -> DataFrame:
    """Step 4: links between chunks of one cell."""
    joined = graph.components(links, scratch)
    reach = 1 - percent / 100 + 1e-9
    members = far.join(joined, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    centre = cells.filter("chunks > 1").join(joined, cells.cell == joined.node, "left").select("cell", "chunks", F.coalesce("component", "cell").alias("home"))
    members = members.join(centre, "cell")
    apart = members.filter("root <> home").groupBy("cell").agg(F.min("far").alias("nearest"))
    members = members.join(apart, "cell").filter((F.col("root") != F.col("home")) | (F.col("far") >= F.col("nearest") - reach))
    dealt = members.withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1))).filter("side <> other")
    dealt = dealt.select("cell", F.least("side", "other").alias("k1"), F.greatest("side", "other").alias("k2"), "node", "root", "side")
    return confirm(dealt).filter("a IS NOT NULL").select("a", "b")


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose component has a smaller doc_id; of repeated doc_ids one row
    stays, rows of a null doc_id all do."""
    found = near_duplicates(docs, percent)
    drop = small(found.filter("NOT kept").select("doc_id").distinct(), BROADCAST)
    left = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if repeated.limit(1).count():
        left = left.filter("doc_id IS NULL").unionByName(left.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    return left
