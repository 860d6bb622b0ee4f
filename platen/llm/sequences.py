"""Token ids as Arrow files of equal-length sequences (operator 2).

Documents are dealt by ranges of doc_id, so that the files in order hold the documents in ascending doc_id order. A
task encodes its documents once and streams them into one Arrow IPC file whose record batches, BATCH sequences each but
for the last, have two fixed-size-list columns: ``ids`` (unsigned integers, as narrow as the vocabulary allows) and
``mask`` (a byte for each id, 0 only in the padding at a file's end; all sequences but the last share one mask, so the
column is dictionary-encoded). A file opened through a memory map gives the ids and the mask of any sequence in constant
time, without copying or decoding. A second, small Arrow file lists the documents. Each file is written under the
attempt's own name and then renamed, so a task that runs again after a lost executor replaces whole files only.

Special strings of the tokenizer in a text are encoded as the library does by default, as their own ids; write_sequences
can take them as ordinary text instead.

Defined cases: a null text is an empty one (only the end id); a very long text runs over as many sequences and batches as
it needs; rows of equal doc_id stay apart, ordered by their texts' hashes (equal rows are alike); rows of null doc_id
come first; an empty table gives no files; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, tune
from .hashing import bounded

#: Ids in a sequence, and sequences in a record batch.
LENGTH, BATCH = 2048, 128
END = 2


def by_ranges(docs: DataFrame) -> DataFrame:
    """doc_id and text in ascending order over partitions and within them; ties are dealt by the text's hash."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    return docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


class _Writer:
    """Streams ids into the sequence file and documents into its list."""

    def __init__(self, folder: str, shard: int, attempt: int, dtype, length: int):
        self.fs, root = _open(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = [f"{root}/shard-{shard:06d}.arrow", f"{root}/shard-{shard:06d}.docs.arrow"]
        self.names = [f"{x}.{attempt}.tmp" for x in self.final]
        self.length, self.kind = length, pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))])
        self.docs = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(x) for x in self.names]
        deltas = pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)  # the padded mask is known at the end only
        self.out = [pa.ipc.new_file(s, x, options=deltas) for s, x in zip(self.sinks, (self.schema, self.docs))]
        self.wait, self.waiting, self.tokens, self.count, self.dtype = [], 0, 0, 0, dtype

    def add(self, doc_ids: pa.Array, ids: np.ndarray, begin: np.ndarray) -> None:
        self.out[1].write_batch(pa.record_batch([doc_ids, pa.array(begin[:-1] + self.tokens), pa.array(np.diff(begin))], schema=self.docs))
        self.tokens, self.count = self.tokens + len(ids), self.count + len(doc_ids)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.length * BATCH:
            self._flush(self.waiting // (self.length * BATCH) * self.length * BATCH)

    def _flush(self, n: int, pad: int = 0) -> None:
        """Write the first ``n`` ids waiting, the last ones followed by ``pad`` zeros."""
        have = np.concatenate([*self.wait, np.zeros(pad, self.dtype)])
        masks = np.ones(2 * self.length if pad else self.length, np.uint8)
        masks[len(masks) - pad :] = 0
        masks = pa.FixedSizeListArray.from_arrays(pa.array(masks), self.length)
        for at in range(0, n + pad, self.length * BATCH):
            part = have[at : min(at + self.length * BATCH, n + pad)]
            which = np.zeros(len(part) // self.length, np.int8)
            which[-1] = pad > 0 and at + len(part) == n + pad
            ids = pa.FixedSizeListArray.from_arrays(pa.array(part), self.length)
            self.out[0].write_batch(pa.record_batch([ids, pa.DictionaryArray.from_arrays(pa.array(which), masks)], schema=self.schema))
        self.wait, self.waiting = [have[n + pad :]], self.waiting - n

    def close(self) -> None:
        if self.waiting:
            self._flush(self.waiting, -self.waiting % self.length)
        for x in (*self.out, *self.sinks):
            x.close()
        for a, b in zip(self.names, self.final):
            self.fs.move(a, b)


@dataclass(frozen=True)
class Manifest:
    """What write_sequences() wrote: (shard, documents, ids) of each file in order."""

    folder: str
    length: int
    shards: tuple[tuple[int, int, int], ...]

    def starts(self) -> list[int]:
        return [0, *np.cumsum([n for _, _, n in self.shards]).tolist()]


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end: int = END, length: int = LENGTH, special: bool = True) -> Manifest:
    """Encode every text with the tokenizers file at ``tokenizer``, append ``end`` to each document and write the files.

    ``folder`` must be one that driver and executors share. The driver gets three numbers for each file. With ``special``
    false, special strings in texts are ordinary text.
    """
    from . import wordpieces

    tune(docs.sparkSession)

    def write(batches):
        task, words, out = TaskContext.get(), wordpieces.load(tokenizer, special), None
        for batch in batches:
            for part in bounded(batch, "text"):
                out = out or _Writer(folder, task.partitionId(), task.taskAttemptId(), words.dtype, length)
                out.add(part.column("doc_id"), *words.encode(part.column("text"), end))
        if out:
            out.close()
            release()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "n": [out.count], "tokens": [out.tokens]})

    rows = by_ranges(docs).mapInArrow(write, "shard long, n long, tokens long").collect()
    return Manifest(folder, length, tuple(sorted((r.shard, r.n, r.tokens) for r in rows)))


class SequenceFile:
    """Random access to one file's sequences; on a local disk without copying."""

    def __init__(self, path: str):
        where, name = _open(path)
        self.source = pa.memory_map(name) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(name)
        self.reader = pa.ipc.open_file(self.source)
        self.batches = self.reader.num_record_batches
        self.full = self.reader.get_batch(0).num_rows if self.batches else 0
        self.length = self.reader.schema.field("ids").type.list_size

    def flat(self, k: int) -> np.ndarray:
        """All ids of batch k, padding included."""
        return self.reader.get_batch(k).column(0).flatten().to_numpy()

    def __len__(self) -> int:
        return self.full * (self.batches - 1) + self.reader.get_batch(self.batches - 1).num_rows if self.batches else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence i: views of the file."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k, row = divmod(i, self.full)
        batch = self.reader.get_batch(k)
        masks, which = batch.column(1).dictionary.flatten().to_numpy(), batch.column(1).indices[row].as_py()
        part = slice(row * self.length, (row + 1) * self.length)
        return batch.column(0).flatten().to_numpy()[part], masks[which * self.length : (which + 1) * self.length].view(bool)


def read_documents(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens and the ids' crc32 (as little-endian 32-bit) of each document."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = [(shard, base) for (shard, _, _), base in zip(manifest.shards, manifest.starts())]
    if not rows:
        return spark.createDataFrame([], schema)
    folder = manifest.folder

    def read(batches):
        for batch in batches:
            for shard, base in zip(*(batch.column(k).to_pylist() for k in range(2))):
                file = SequenceFile(f"{folder}/shard-{shard:06d}.arrow")
                where, name = _open(f"{folder}/shard-{shard:06d}.docs.arrow")
                k, low, have = -1, 0, np.empty(0, np.uint32)
                with where.open_input_file(name) as source:
                    listed = pa.ipc.open_file(source)
                    for part in (listed.get_batch(i) for i in range(listed.num_record_batches)):
                        sums = []
                        for start, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                            crc, at = 0, start
                            while at < start + n:
                                while at >= low + len(have):
                                    k, low = k + 1, low + len(have)
                                    have = file.flat(k).astype("<u4")
                                piece = have[at - low : start + n - low]
                                crc, at = zlib.crc32(piece, crc), at + len(piece)
                            sums.append(crc)
                        starts = pa.array(part.column(1).to_numpy() + base)
                        yield pa.RecordBatch.from_arrays([part.column(0), starts, part.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "shard long, base long").repartition(len(rows), "shard")
    return files.mapInArrow(read, schema)
