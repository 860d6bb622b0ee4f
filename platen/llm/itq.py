"""Near-duplicate vectors by iterative quantisation (operator 1).

A rotation is learnt on a bounded sample (the first principal axes, then alternating between signs and the orthogonal
rotation that best reaches them), and the signs of the rotated vectors are the code. Each vector length has a model of
its own, from a sample of its own vectors. Substrings of the code, from as many rotations as they need, index every
vector: vectors that agree in a substring meet in its bucket. Pairs that differ in fewer bits than there are tables
always meet. Substrings lengthen with the number of vectors, so that buckets stay small, and the tables become as many
as a pair at the threshold of 0.93 needs to meet with a chance of 1 - MISSED (16 for eight bits); closer pairs meet
more surely. The bits are signs about the mean, and where vectors share a direction such a pair differs in more of them
than its angle about the origin says. So the plan comes from the agreement of pairs at the threshold that are made from
the sample (``agreements``): if table_plan's tables are too few for it, the plan is the cheapest one that has enough,
with shorter substrings if need be, down to one bucket for all.

The tables hold codes, not vectors. In a bucket codes are compared by Hamming distance, up to one that pairs at the
threshold stay well below (``radius``), and only members with such a partner that they meet here for the first time get
their vector sent to this bucket, where the vectors are compared by cosine in double precision. A vector is thus sent
as often as it has buckets with a new near partner, however many tables there are.

Exact copies are one class first, with a count. A bucket larger than BLOCK is dealt as pairs of blocks, so no task gets
more than two blocks of it; which buckets those are is counted beforehand and joined to the index, by broadcast only
up to HOT of them. A pair is counted in the first table where it
meets. Tasks return a row for each vector with links, its count and one link into the bucket's local component: never
the pairs.

Defined cases: a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; vectors of different lengths are not compared, and a length with few vectors, or of thousands of components,
has its model like any other; a cosine of exactly the threshold links; each row of a repeated vec_id is a vector of its
own that links with the others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .common import Scratch, salted_join, small, tune
from .language import hash_bound

BLOCK = 2048
#: Large buckets that are broadcast; more of them are joined by shuffling.
HOT = 100_000
#: Chance that a pair at the threshold of 0.93 meets in no table.
MISSED = 0.001
#: Vectors that a length's rotation is learnt from (fewer of long ones: at least LEAST, else VALUES components in all), bits of a rotation, and rounds.
SAMPLE, LEAST, VALUES, WIDTH, ROUNDS = 4096, 64, 1 << 22, 256, 30
#: Pairs of each kind that the agreement is measured on, bits for it, and comparisons that cost as much as a row of the index.
PAIRS, MEASURED, ROW = 1000, 1024, 256
#: Rows of the index that are made at once.
ROWS = 1 << 16


def table_plan(vectors: int) -> tuple[int, int]:
    """Bits of a substring and number of tables for so many vectors."""
    bits = int(min(24, max(8, np.log2(max(vectors, 2)) // 1 - 7)))
    agree = (1 - np.arccos(0.93) / np.pi) ** bits
    return bits, int(np.ceil(np.log(MISSED) / np.log(1 - agree)))


def agreements(x: np.ndarray, rotations: list[tuple[np.ndarray, np.ndarray]], cosine: float = 0.93) -> list[np.ndarray]:
    """Parts of the bits in which pairs at ``cosine`` agree, one array for each kind of pair.

    One vector is a row of the unit rows ``x``; the other is turned from it in any direction, or towards another row.
    """
    r = np.random.default_rng(0)
    a = x[r.integers(0, len(x), PAIRS)]
    out = []
    for towards in (r.normal(size=a.shape), x[r.integers(0, len(x), PAIRS)], -x[r.integers(0, len(x), PAIRS)]):
        w = towards - (towards * a).sum(axis=1, keepdims=True) * a
        norm = np.sqrt((w * w).sum(axis=1))
        some = norm > 1e-6  # a copy of the same row gives no direction
        b = cosine * a[some] + np.sqrt(1 - cosine * cosine) * w[some] / norm[some, None]
        same = [((a[some] - m) @ t >= 0) == ((b - m) @ t >= 0) for m, t in rotations]
        if some.any():
            out.append(np.concatenate(same, axis=1).mean(axis=1))
    return out


def _tables(agree: list[np.ndarray], bits: int) -> int:
    """The fewest tables with which pairs of each kind are missed with a chance of MISSED at most, on average."""
    missed = [1 - a**bits for a in agree]
    enough = lambda n: all((m**n).mean() <= MISSED for m in missed)
    high = 1
    while not enough(high) and high < 1 << 20:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high


def measured_plan(vectors: int, agree: list[np.ndarray]) -> tuple[int, int]:
    """table_plan() if its tables are enough for the measured agreement, else the cheapest plan with enough of them."""
    bits, tables = table_plan(vectors)
    need = {k: _tables(agree, k) for k in range(bits + 1)}
    if need[bits] <= tables:
        return bits, tables
    best = min(need, key=lambda k: (need[k] * (ROW + vectors / 2**k), k))
    return best, need[best]


def radius(agree: list[np.ndarray], size: int) -> int:
    """Bits of a code of ``size`` in which two vectors may differ to be compared: those of the farthest pair measured at
    the threshold, and five standard deviations of a code of this size."""
    part = max((float(1 - a.min()) for a in agree), default=0.0)
    return min(size, int(np.ceil(size * part + 5 * np.sqrt(size * 0.25 if part >= 0.5 else size * part * (1 - part)))))


def learn_model(x: np.ndarray, vectors: int) -> tuple[int, int, int, list[tuple[np.ndarray, np.ndarray]]]:
    """Bits, tables, radius and rotations for ``vectors`` vectors of one length, of which the unit rows ``x`` are a sample."""
    axes = principal(x)
    width = axes[1].shape[1]
    rotations = [learn_rotation(x, axes, seed) for seed in range(min(64, -(-MEASURED // width)))]
    agree = agreements(x, rotations)
    bits, tables = measured_plan(vectors, agree)
    wanted = max(1, -(-tables * bits // width))
    return bits, tables, radius(agree, tables * bits), rotations[:wanted] + [learn_rotation(x, axes, seed) for seed in range(len(rotations), wanted)]


def principal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the first WIDTH principal axes (orthonormal columns) of the rows of ``x``."""
    d = x.shape[1]
    width, mean = min(d, WIDTH), x.mean(0)
    axes = np.linalg.svd(x - mean, full_matrices=False)[2].T[:, :width]
    if axes.shape[1] < width:  # fewer rows than bits: any other directions
        axes = np.linalg.qr(np.concatenate([axes, np.random.default_rng(0).normal(size=(d, width - axes.shape[1]))], axis=1))[0]
    return mean, axes


def learn_rotation(x: np.ndarray, principal: tuple[np.ndarray, np.ndarray], seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and orthonormal columns, a bit each, fitted to the rows of ``x``."""
    mean, axes = principal
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    z = (x - mean) @ axes
    for _ in range(rounds if len(x) > 1 else 0):
        u, _, v = np.linalg.svd(np.where(z @ turn >= 0, 1.0, -1.0).T @ z)
        turn = (u @ v).T
    return mean, axes @ turn


def codes_of(x: np.ndarray, rotations: list[tuple[np.ndarray, np.ndarray]], tables: int, bits: int) -> np.ndarray:
    """The code of unit rows ``x``: booleans, tables x bits columns."""
    return np.concatenate([((x - m) @ r) >= 0 for m, r in rotations], axis=1)[:, : tables * bits]


def substrings(code: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The code's substrings: integers, one column a table."""
    return (code.reshape(len(code), tables, bits) @ (1 << np.arange(bits))).astype(np.int32).reshape(len(code), tables)


def pack(code: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words, at least one."""
    raw = np.packbits(code, axis=1, bitorder="little")
    out = np.zeros((len(code), max(8, -(-raw.shape[1] // 8) * 8)), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view(np.uint64)


def unpack(words: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Substrings of packed codes."""
    code = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little", count=tables * bits)
    return substrings(code, tables, bits)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(batch: pa.RecordBatch):
    sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        yield d, batch.filter(pa.array(sizes == d))


def _index(models, full: bool):
    """Rows (label, d, t, code, node, words), one for each vector and table; if not ``full`` the bucket's name only."""

    def run(batches):
        for batch in batches:
            for d, whole in _by_length(batch):
                bits, tables, _, rotations = models.value[d]
                step = max(1, ROWS // tables)
                for low in range(0, whole.num_rows, step):
                    part = whole.slice(low, step)
                    code = codes_of(_unit(_matrix(part.column("vector"), d)), rotations, tables, bits)
                    n = part.num_rows
                    at = pa.array(np.repeat(np.arange(n), tables))
                    t = pa.array(np.tile(np.arange(tables, dtype=np.int32), n))
                    named = [part.column("label").take(at), pa.array(np.full(n * tables, d, np.int32)), t, pa.array(substrings(code, tables, bits).reshape(-1))]
                    names = ["label", "d", "t", "code"]
                    if full:
                        words = pack(code)
                        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(words.shape[1] * 8), n, [None, pa.py_buffer(words)]).cast(pa.binary())
                        named += [part.column("node").take(at), packed.take(at)]
                        names += ["node", "words"]
                    yield pa.RecordBatch.from_arrays(named, names=names)

    return run


def _deal(index: DataFrame, hot: DataFrame) -> DataFrame:
    """``index`` with k1, k2 and side: a row of a bucket of several blocks has its block as side and comes once for each
    pair of blocks (k1, k2) that its own is part of."""
    joined = index.join(small(hot, HOT), ["label", "d", "t", "code"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = joined.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"k1": F.least("side", "other"), "k2": F.greatest("side", "other")}).drop("other", "blocks")


def _met(i: np.ndarray, j: np.ndarray, t: int, k1: int, k2: int, side: np.ndarray, codes: np.ndarray, mixed: bool) -> np.ndarray:
    """Which pairs (i, j) of a bucket, or of a pair of its blocks, meet here for the first time."""
    keep = i < j
    if k1 != k2:
        keep &= side[i] != side[j]
    elif mixed:
        keep &= side[i] == side[j]
    if t:
        at = np.flatnonzero(keep)
        keep[at] = ~(codes[i[at], :t] == codes[j[at], :t]).any(axis=1)
    return keep


def _pairs(n: int, near):
    """Pairs (i, j) for which ``near``, given a slice of rows, holds in its matrix of these rows and all from the first of them on."""
    for low in range(0, n, 512):
        i, j = np.nonzero(near(low, min(low + 512, n)))
        yield i + low, j + low


def _near_codes(table: pa.RecordBatch, models) -> pa.RecordBatch:
    """Members of one bucket that have a partner within the radius, met here for the first time."""
    t, k1, k2, d = (table.column(c)[0].as_py() for c in ("t", "k1", "k2", "d"))
    bits, tables, most, _ = models.value[d]
    words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64).reshape(table.num_rows, -1)
    side, codes = table.column("side").to_numpy(), unpack(words, tables, bits)
    mixed, some = len(np.unique(side)) > 1, np.zeros(len(words), bool)

    def near(low, high):
        apart = np.zeros((high - low, len(words) - low), np.uint16)
        for w in range(words.shape[1]):
            apart += np.bitwise_count(words[low:high, None, w] ^ words[None, low:, w])
        return apart <= most

    for i, j in _pairs(len(words), near):
        keep = _met(i, j, t, k1, k2, side, codes, mixed)
        some[i[keep]] = some[j[keep]] = True
    return table.filter(pa.array(some))


def _near_vectors(table: pa.RecordBatch, models, least: float) -> pa.RecordBatch:
    """Links of one bucket: per vector with links its weighted count and the local root."""
    t, k1, k2, d = (table.column(c)[0].as_py() for c in ("t", "k1", "k2", "d"))
    bits, tables, _, _ = models.value[d]
    words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64).reshape(table.num_rows, -1)
    side, codes, node, n = table.column("side").to_numpy(), unpack(words, tables, bits), table.column("node").to_numpy(), table.column("n").to_numpy()
    x = _unit(_matrix(table.column("vector"), d))
    links, parent, mixed = np.zeros(len(x), np.int64), np.arange(len(x)), len(np.unique(side)) > 1
    for i, j in _pairs(len(x), lambda low, high: x[low:high] @ x[low:].T >= least):
        keep = _met(i, j, t, k1, k2, side, codes, mixed)
        i, j = i[keep], j[keep]
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        while i.size:  # every root joins the smallest one that a pair links it to
            a, b = parent[i], parent[j]
            apart = a != b
            i, j = i[apart], j[apart]
            np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (parent[parent] != parent).any():
                parent = parent[parent]
    at = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (node[at], links[at], node[parent[at]])], names=["node", "links", "root"])


BUCKET = ["label", "d", "t", "code", "k1", "k2"]


def _by_bucket(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work``'s rows for each bucket of at least two rows; buckets are worked through one after the other."""

    def run(batches):
        last, kept = None, []

        def finish():
            if sum(x.num_rows for x in kept) > 1:
                made = work(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
                if made.num_rows:
                    yield made

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in BUCKET]
            cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if (key := tuple(k[a] for k in keys)) != last:
                    yield from finish()
                    kept, last = [], key
                kept.append(batch.slice(a, b - a))
        yield from finish()

    return rows.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInArrow(run, schema)


def near_vectors(vectors: DataFrame, least: float = 0.93, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "vectors")
    wide = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("vector"), F.col("label").cast("string").alias("label"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vector") > 0)
    sound &= F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound &= F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256)))
    rows = scratch.written(rows, "vectors")
    narrow = F.col("vector").cast("array<float>")  # the stored width, if that loses nothing
    classes = rows.filter("key IS NOT NULL").groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    stored = dict(vectors.dtypes).get("embedding") == "array<float>"
    classes = classes.withColumn("vector", narrow) if stored else classes
    # a vec_id may stand for several vectors, so classes have numbers of their own
    classes = scratch.written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    lengths = {r.d: r["count"] for r in classes.groupBy(F.size("vector").alias("d")).count().collect()}
    models = {d: learn_model(x, lengths[d]) for d, x in _samples(classes, lengths, sample)}
    models = spark.sparkContext.broadcast(models)

    names = classes.mapInArrow(_index(models, False), "label string, d int, t int, code int")
    hot = names.groupBy("label", "d", "t", "code").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).filter("blocks > 1")
    index = classes.mapInArrow(_index(models, True), "label string, d int, t int, code int, node long, words binary")
    index = _deal(index, scratch.written(hot, "hot"))
    member = "label string, d int, t int, code int, node long, words binary, side int, k1 int, k2 int"
    near = _by_bucket(index.select(*[x.split()[0] for x in member.split(", ")]), lambda table: _near_codes(table, models), member)
    near = scratch.written(near, "near")
    near = near.join(classes.select("node", "n", "vector"), "node")
    met = scratch.written(_by_bucket(near, lambda table: _near_vectors(table, models, least), "node long, links long, root long"), "met")
    joined = graph.components(met.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    joined = joined.join(classes.select("node", "least"), "node")
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = salted_join(joined, named, ["component"], "node").select("node", "component_id")
    each = classes.select("label", "key", "node", "least", "n").join(counts, "node", "left").join(joined, "node", "left")
    each = each.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    found = salted_join(rows.filter("key IS NOT NULL").select("vec_id", "label", "key"), each, ["label", "key"], "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return scratch.done(out)


def _samples(classes: DataFrame, lengths: dict[int, int], sample: int):
    """(length, unit rows) of a bounded sample of each length, by the vectors' hashes."""
    if not lengths:
        return
    most = {d: min(sample, max(LEAST, VALUES // d)) for d in lengths}
    hashed = classes.select("vector", F.size("vector").alias("d"), F.xxhash64("key").alias("h"))
    for d, n in sorted(lengths.items()):
        drawn = hashed.filter((F.col("d") == d) & (F.col("h") <= hash_bound(4 * most[d], n))).orderBy("h").limit(most[d]).select("vector").toArrow()
        if not drawn.num_rows:  # hashes may all lie beyond the bound
            drawn = hashed.filter(F.col("d") == d).limit(most[d]).select("vector").toArrow()
        yield d, _unit(_matrix(drawn.column("vector").combine_chunks(), d))
