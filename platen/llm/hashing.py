"""Vectorised hashing of words, shingles and code points straight from Arrow string buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text hashed at once; longer texts go block by block.
BLOCK = 1 << 18
SHINGLE = 5
_WEIGHTS = np.random.default_rng(20240501).integers(1, 2**63, size=16, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        line = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
        line[0] = 1
        _powers[kind] = np.cumprod(line, dtype=np.uint64)
    return _powers[kind][:n]


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; a polynomial in the bytes, taken by prefix sums."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        part = data[low : ends[to - 1]].astype(np.uint64) + _U(1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * _power("up", _BASE, len(part)), dtype=np.uint64, out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * _power("down", _INVERSE, len(part) + 1)[s] + (e - s).astype(np.uint64))
        if len(part) > BLOCK + 1:
            _powers.clear()
        at = to
    return out


def _pieces(texts: pa.Array):
    """(first document, data, offsets) of slices of the column with about BLOCK bytes or one document."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than 0x20 and 0x09-0x0D) and their documents."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(texts: pa.Array):
    """For each text in order the sorted distinct 64-bit hashes of its shingles of five words, A-Z lower-cased.

    A text of fewer words has its whole sequence as its one shingle; a text without words, or null, an empty array.
    """
    for _, data, offsets in _pieces(texts):
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        starts, ends, docs = word_bounds(data, offsets)
        words = _hash_words(data, starts, ends)
        counts = np.bincount(docs, minlength=len(offsets) - 1)
        at = 0
        for n in counts.tolist():
            if n >= SHINGLE:
                w = words[at : at + n]
                total = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
                for k in range(SHINGLE):
                    total += w[k : n - SHINGLE + 1 + k] * _WEIGHTS[k]
                yield np.unique(mix(total))
            elif n:
                yield mix((words[at : at + n] * _WEIGHTS[:n]).sum(dtype=np.uint64, keepdims=True) + _WEIGHTS[8 + n])
            else:
                yield np.empty(0, np.uint64)
            at += n


def bounded(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of the batch whose text column has about ``most`` bytes, or one row."""
    sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)), dtype=np.int64, count=batch.num_rows)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
