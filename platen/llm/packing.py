"""Order-preserving packing by dynamic programming (operator 9).

Documents follow each other in ascending doc_id order. Windows of at most ``size`` ids are cut at document ends, at
sentence ends or, at a price, anywhere; the cuts minimise padding plus truncation penalties. With f(j) the least cost
up to cut j, f(j) = penalty(j) + min over the cuts i within reach of f(i) + size - (p(j) - p(i)): the part that depends
on i is kept in a monotone queue, so each cut enters and leaves it once. A window whose length is a power of two needs
no padding, which is looked at cut by cut for halves and quarters of ``size``. What remains at a partition's end is cut into powers of two as long as a
cut costs less than the padding that it saves.

Partitions are ranges of doc_id and are packed alone; the number of sequences of each gives the global sequence_id.
A partition is worked through in runs of whole documents of about RUN ids; the last window of a run stays open.

Special strings of the tokenizer in a text are encoded as the library does by default, as their own ids.

Defined cases: a null text is an empty one (its end id only); a text of more ids than a run is a run of its own; equal
doc_ids keep their own rows, ordered by their texts' hashes, null doc_ids come first; of equally cheap cuts the earlier
found stays; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small, tune, written
from .hashing import bounded
from .sequences import END, by_ranges

SIZE = 4096
#: Costs, in ids of padding, of a cut at a sentence end and of one anywhere else.
AT_SENTENCE, ANYWHERE = 8, 96
RUN = 1 << 20
#: Bytes of text encoded at once; the words of a part are in memory together.
PART = 1 << 20


def best_cuts(places: np.ndarray, costs: np.ndarray, size: int = SIZE) -> list[int]:
    """Indexes of the cuts chosen from ``places`` (ascending; the first is 0, no gap over ``size``); the first and last are always chosen."""
    n = len(places)
    p, cost = places.tolist(), costs.tolist()
    exact: dict[int, list[int]] = {}
    for u in (size // 4, size // 2) if size & (size - 1) == 0 else ():
        at = np.searchsorted(places, places - u)
        for j in np.flatnonzero((places >= u) & (places[np.minimum(at, n - 1)] == places - u)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
    f, back = [0.0] * n, [0] * n
    queue, keys, head = [0], [0.0], 0  # cuts within reach and their f(i) + p(i), ascending from head
    for j in range(1, n):
        here = p[j]
        while p[queue[head]] < here - size:
            head += 1
        i = queue[head]
        least = keys[head] + size - here
        if j in exact:
            for k in exact[j]:
                if f[k] < least:
                    least, i = f[k], k
        f[j] = least = least + cost[j]
        back[j] = i
        least += here
        while len(keys) > head and keys[-1] >= least:
            del keys[-1], queue[-1]
        keys.append(least)
        queue.append(j)
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def tail(n: int, size: int = SIZE, anywhere: int = ANYWHERE) -> list[int]:
    """Lengths into which the last ``n`` ids are cut: leading powers of two, then what is cheapest to pad."""
    best, lengths, rest, spent, head = None, [], n, 0, []
    while rest:
        padding = 0 if rest & (rest - 1) == 0 else size - rest
        if best is None or spent + padding < best:
            best, lengths = spent + padding, [*head, rest]
        top = 1 << (rest.bit_length() - 1)
        if top == rest:
            break
        head, rest, spent = [*head, top], rest - top, spent + anywhere
    return lengths


class _Packer:
    """Packs the documents of one partition as they come."""

    def __init__(self, stops: np.ndarray, size: int):
        self.stops, self.size = stops, size
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # (doc_id, ids of the document before this run, here, ids of the document)
        self.have = self.sequence = 0

    def add(self, doc_ids: list, ids: np.ndarray, begin: np.ndarray):
        at = 0
        while at < len(doc_ids):
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + max(1, RUN - self.have), "right")) - 1)
            self.ids.append(ids[begin[at] : begin[to]])
            sizes = np.diff(begin[at : to + 1]).tolist()
            self.docs += [(d, 0, n, n) for d, n in zip(doc_ids[at:to], sizes)]
            self.have += int(begin[to] - begin[at])
            at = to
            if self.have >= RUN:
                yield self._pack(False)

    def end(self):
        if self.have:
            yield self._pack(True)

    def _pack(self, last: bool) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        edges = np.concatenate([[0], np.cumsum([n for _, _, n, _ in self.docs])])
        sentence = np.flatnonzero(self.stops[ids]) + 1
        places = np.sort(np.concatenate([edges, sentence]))
        places = places[np.diff(places, prepend=-1) > 0]
        gaps = np.diff(places)
        if (wide := np.flatnonzero(gaps > self.size)).size:
            more = [np.arange(places[i], places[i + 1], self.size)[1:] for i in wide]
            more += [x + int(gaps[i] % self.size) for i, x in zip(wide, more)]
            places = np.unique(np.concatenate([places, *more]))
            places = places[places <= len(ids)]
        costs = np.full(len(places), float(ANYWHERE))
        costs[np.searchsorted(places, sentence)] = AT_SENTENCE
        costs[np.searchsorted(places, edges)] = 0
        cuts = places[best_cuts(places, costs, self.size)]
        if last:
            cuts = np.concatenate([cuts[:-1], cuts[-2] + np.cumsum(tail(int(cuts[-1] - cuts[-2]), self.size))])
        elif len(cuts) > 2:
            cuts = cuts[:-1]
        done = int(cuts[-1])
        both = np.union1d(edges[edges <= done], cuts)
        doc = np.searchsorted(edges, both[:-1], "right") - 1
        window = np.searchsorted(cuts, both[:-1], "right") - 1
        raw = ids[:done].astype("<u4")
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(both[:-1].tolist(), both[1:].tolist())]
        before = np.array([b for _, b, _, _ in self.docs])
        out = pa.RecordBatch.from_pydict({
            "doc_id": pa.array([self.docs[k][0] for k in doc.tolist()], pa.int64()),
            "start": both[:-1] - edges[doc] + before[doc],
            "length": np.diff(both),
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": np.array([n for _, _, _, n in self.docs])[doc],
            "sequence_id": self.sequence + window,
            "offset": both[:-1] - cuts[window],
        })
        self.sequence += len(cuts) - 1
        k = int(np.searchsorted(edges, done, "right")) - 1
        rest = self.docs[k:]
        if rest and done > edges[k]:
            d, b, n, total = rest[0]
            rest = [(d, b + done - int(edges[k]), n - done + int(edges[k]), total), *rest[1:]]
        self.docs, self.ids, self.have = rest, [ids[done:]], len(ids) - done
        return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end: int = END, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id and
    offset in the sequence. Every id lies in exactly one piece."""
    from . import wordpieces

    tune(docs.sparkSession)

    def run(batches):
        words, part = wordpieces.load(tokenizer), TaskContext.get().partitionId()
        stops = words.stops if len(words.stops) > end else np.zeros(end + 1, bool)
        packer = _Packer(stops, size)

        def tagged(made):
            for x in made:
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(np.full(x.num_rows, part, np.int64))], names=[*x.schema.names, "part"])

        for batch in batches:
            for x in bounded(batch, "text", PART):
                yield from tagged(packer.add(x.column("doc_id").to_pylist(), *words.encode(x.column("text"), end)))
        yield from tagged(packer.end())
        release()

    pieces = written(by_ranges(docs).mapInArrow(run, PIECES + ", part long"), "pieces")
    counts = sorted(pieces.groupBy("part").agg((F.max("sequence_id") + 1).alias("n")).collect())
    bases = [(p, int(b)) for (p, _), b in zip(counts, np.cumsum([0, *(n for _, n in counts)]))]
    bases = docs.sparkSession.createDataFrame(bases, "part long, base long")
    return pieces.join(small(bases, 100_000), "part").withColumn("sequence_id", F.col("sequence_id") + F.col("base")).drop("part", "base")
