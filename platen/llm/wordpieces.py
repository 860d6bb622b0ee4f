"""Batch encoding with a tokenizers file, words made distinct first where its tokens never cross white space.

The words of a batch are made distinct; each distinct word is encoded once and the ids are put together by position.
Words of plain Latin letters and marks go to the file's BPE model in one call; all others, and words that hold a special
string, go through the whole tokenizer, so every id is one that the tokenizers library gave. That this is the same is
read from the file: a normaliser of canonical composition, white space to a space and lower-casing, a split by a pattern
that leaves white space out, bytes as characters, and a BPE model with word ends. Texts of any other file are encoded
whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a Python worker remembers; beyond that it starts anew.
REMEMBERED = 600_000
#: Characters that normalisation only lower-cases, one by one.
_PLAIN = re.compile("[\x21-\x7e¡-įı-ž]+")
_loaded: dict[tuple[str, bool], "WordPieces"] = {}


def load(path: str, special: bool = True) -> "WordPieces":
    """The tokenizer; ``special``: whether special strings in texts are their own ids, as by the library's default."""
    if (path, special) not in _loaded:
        _loaded[path, special] = WordPieces(path, special)
    return _loaded[path, special]


def word_pattern(described: dict) -> str | None:
    """The pattern that splits words, if the tokenizer so described works on each word alone in the way stated above."""
    norm, pre, model = (described.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = norm.get("normalizers", [])
    known = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    parts = pre.get("pretokenizers", [])
    known = known and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    known = known and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"] and model.get("end_of_word_suffix") == "</w>"
    known = known and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    known = known and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in described["added_tokens"])
    pattern = parts[0]["pattern"].get("Regex") if known else None
    return pattern if pattern and "^\\s" in pattern else None


class WordPieces:
    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = not special
        self.special = [x["content"].lower() for x in described["added_tokens"]]
        self.model = Tokenizer(self.full.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        pattern = word_pattern(described)
        self.split = regex.compile(pattern) if pattern else None
        vocabulary = self.full.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends, self.stops = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocabulary.items():
            if token.endswith("</w>"):
                self.ends[i] = True
                body = token[:-4]
                self.stops[i] = bool(re.fullmatch(r"[.!?\"')\]]*[.!?][.!?\"')\]]*", body))
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {b: shown.pre_tokenize_str(chr(b))[0][0] if b < 128 else "" for b in range(256)}
        for b in range(128, 256):  # the last byte of a two-byte character shows how its byte is written
            text = bytes([0xC2 + (b >= 0xC0), 0x80 + (b & 0x3F)]).decode()
            self.shown[0x80 + (b & 0x3F)] = shown.pre_tokenize_str(text)[0][0][1]
        for b in range(0xC2, 0xF5):
            text = (bytes([b, 0x80]) if b < 0xE0 else bytes([b, 0xA0, 0x80]) if b < 0xED else bytes([b, 0x80, 0x80]) if b < 0xF0 else bytes([b, 0x90 if b == 0xF0 else 0x80, 0x80, 0x80])).decode("utf-8", "replace")
            if "�" not in text:
                self.shown[b] = shown.pre_tokenize_str(text)[0][0][0]
        self.shown[32] = " "
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {"": 0}
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.ids, self.used = np.zeros(1 << 14, self.dtype), 0

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.slots), len(words)
        while n + m > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n : n + m] = self.used + np.concatenate([[0], np.cumsum(sizes)])[:m]
        self.sizes[n : n + m] = sizes
        self.used += len(ids)
        self.slots.update(zip(words, range(n, n + m)))

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if _PLAIN.fullmatch(w)] if self.split else []
        joined = " ".join(plain).lower()
        if any(x in joined for x in self.special):
            plain = [w for w in plain if not any(x in w.lower() for x in self.special)]
            joined = " ".join(plain).lower()
        if plain:
            low = joined.split(" ")
            counts = np.ones(len(low), np.int64)
            for i in [i for i, w in enumerate(low) if not w.isalpha()]:  # letters alone are never split
                parts = self.split.findall(low[i])
                counts[i], low[i] = len(parts), " ".join(parts)
            flat = " ".join(low)
            flat = flat if flat.isascii() else flat.encode().decode("latin-1").translate(self.shown)
            ids = np.array(self.model.encode_batch_fast([flat], add_special_tokens=False)[0].ids, dtype=self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            upto = np.cumsum(counts)
            if len(stops) == upto[-1]:  # each part ended in a word end
                self._add(plain, ids, np.diff(stops[upto - 1], prepend=0))
                words = [w for w in words if w not in self.slots]
        if words:
            found = [e.ids for e in self.full.encode_batch_fast(words, add_special_tokens=False)]
            self._add(words, np.array([i for x in found for i in x], dtype=self.dtype), np.array([len(x) for x in found]))

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text begins in it (one more than texts); a null is empty.
        ``end`` is appended to each text."""
        texts = texts.fill_null("") if texts.null_count else texts
        lists = pc.ascii_split_whitespace(texts) if self.split else pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32), texts)
        words = lists.flatten().dictionary_encode()
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]) if len(lists) else np.zeros(1, np.int64)
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
        if len(self.slots) > REMEMBERED or not self.split:
            self.forget()
        get = self.slots.get
        slot = np.array([get(w, -1) for w in names], dtype=np.int64)
        if (unknown := np.flatnonzero(slot < 0)).size:
            new = [names[i] for i in unknown.tolist()]
            self._learn(new)
            slot[unknown] = [self.slots[w] for w in new]
        slot = slot[words.indices.to_numpy(zero_copy_only=False)] if len(words) else slot
        sizes = self.sizes[slot].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[slot] - upto[:-1], sizes) + np.arange(upto[-1])]
        begin = upto[bounds]
        if end is None:
            return ids, begin
        n = len(texts)
        out = np.empty(len(ids) + n, self.dtype)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(begin))] = ids
        begin = begin + np.arange(n + 1)
        out[begin[1:] - 1] = end
        return out, begin
