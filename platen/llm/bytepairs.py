"""Byte-level BPE by a sentencepiece model that is written directly from a rank file (operator 6).

Byte b is written as the character U+0100 + b. The model's pieces are the vocabulary's byte strings so written, scored
by negative rank, so the piece merged next is always that of the lowest rank, the leftmost of equals. Normalisation is
the identity. A text is split by the pattern; each distinct pre-token of a batch is encoded once, and a pre-token that
is itself in the vocabulary is that entry, as the rank files' own library does it. Decoding maps ids back to pieces,
and their characters to bytes.

Defined cases: a null or empty text has no ids; very long texts are encoded whole; of two equally ranked merges the left
one comes first, as in the rank files' own library; special strings are ordinary text; equal doc_ids keep their own rows;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune
from .hashing import bounded

REMEMBERED = 400_000
_loaded: dict[tuple[str, str], "BytePairs"] = {}


def load(path: str, pattern: str) -> "BytePairs":
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = BytePairs(path, pattern)
    return _loaded[path, pattern]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file by rank; ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("the ranks have gaps")
    return [t for _, t in pairs]


def shown(raw: bytes) -> str:
    """Bytes as characters U+0100 to U+01FF."""
    wide = np.frombuffer(raw, np.uint8).astype("<u2") + 0x100
    return wide.tobytes().decode("utf-16-le")


def hidden(text: str) -> bytes:
    """The inverse of shown()."""
    return text.encode("utf-16-le")[::2]


def _varint(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    """One field of a protocol-buffer message: bytes, integer or float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).astype("<f4").tobytes()
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model; its id 0 is the unknown piece, id r + 1 the token of rank r."""
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    pieces = [_field(1, _field(1, shown(t).encode()) + _field(2, -float(r)) + _field(3, 1)) for r, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, 0) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return unknown + b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class BytePairs:
    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.rank = {t: r for r, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.find = regex.compile(pattern).findall
        self.piece = [hidden(self.model.id_to_piece(i + 1)) for i in range(len(self.tokens))]
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        whole = [self.rank.get(x) for x in raw]
        rest = [k for k, r in enumerate(whole) if r is None]
        found = dict(zip(rest, self.model.encode([shown(raw[k]) for k in rest], out_type=int, num_threads=1))) if rest else {}
        for k, w in enumerate(words):
            ids = np.array(found[k], "<u4") - np.uint32(1) if k in found else np.array([whole[k]], "<u4")
            self.known[w] = ids.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        words = self.find(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            self.learn([w for w in dict.fromkeys(words) if w not in known])
            return b"".join([known[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        piece = self.piece
        return b"".join([piece[i] for i in np.frombuffer(ids, "<u4").tolist()])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, the digest of the ids and of the bytes decoded from them, for every whole text."""
    tune(docs.sparkSession)

    def run(batches):
        pairs = load(path, pattern)
        for batch in batches:
            for part in bounded(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                new = dict.fromkeys(chain.from_iterable(map(pairs.find, texts))) if len(pairs.known) < REMEMBERED // 2 else {}
                if new := [w for w in new if w not in pairs.known]:
                    pairs.learn(new)  # many at once: calls are what costs
                ids = [pairs.encode(t) for t in texts]
                back = [hashlib.sha256(pairs.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
