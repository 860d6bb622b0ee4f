"""The registered queries over the smallest tables: against SQL, or a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from platen.llm import language, quality, queries
from platen.llm.sql import ORACLES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same):
    same(queries.queries()[name], ORACLES[name])


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_sequences_and_packing(spark, texts):
    from tokenizers import Tokenizer

    t, start, expected = Tokenizer.from_file(queries.WORDS), 0, {}
    for i in sorted(texts):
        ids = np.array(t.encode(texts[i], add_special_tokens=False).ids + [2], "<u4")
        expected[i] = (start, len(ids), zlib.crc32(ids), ids)
        start += len(ids)
    whole = {i: x[3] for i, x in expected.items()}
    for r in queries.op2_arrow_sequences(spark, DATA).collect():
        assert (r.start, r.n_tokens, r.ids_crc32) == expected.pop(r.doc_id)[:3]
    assert not expected
    pieces = queries.op9_packing(spark, DATA).collect()
    used, covered = {}, {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        ids = whole[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length]) and p.length > 0
        assert p.offset == used.get(p.sequence_id, 0)
        used[p.sequence_id] = p.offset + p.length
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 4096
    for i, ids in whole.items():
        spans = sorted(covered[i])
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()] and sum(n for _, n in spans) == len(ids)
    assert sum(0 if n & (n - 1) == 0 else 4096 - n for n in used.values()) < 0.02 * start


def test_byte_pairs(spark, texts):
    import base64

    import public_tokenizers
    import tiktoken

    with open(queries.BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op6_byte_bpe(spark, DATA).collect():
        ids = np.array(own.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_quality(rows, labels):
    """The doc_ids that the first stage keeps, one document at a time."""
    made = {}
    for i, text, lang in rows:
        w, text = re.findall(r"[^\x20\x09-\x0D]+", text or ""), text or ""
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = Counter(grams)
        covered = {j for k, g in enumerate(grams) if seen[g] > 1 for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = max(len(w), 1)
        signals = {"symbols_per_word": len(re.findall(r"[#*$%&|<>]", text)) / n, "duplicate_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeated_words": len(covered) / n, "mean_word_length": sum(map(len, w)) / n}
        made[i] = (lang or "", len(w) < 10 or 100 * len(covered) > 20 * len(w), signals)
    strata = {made[i][0] for i in labels if i in made and not made[i][1]}
    cutoffs = {}
    for stratum in strata:
        known = [(made[i][2], q) for i, q in labels.items() if i in made and made[i][0] == stratum and not made[i][1]]
        n, rate = sum(q == 1 for _, q in known), quality.ALPHA / len(quality.SIGNALS)
        for name, grid in quality.SIGNALS.items():
            best = (0, None)
            for cutoff in reversed(grid):  # from the loosest on
                k, bad = (sum(s[name] > cutoff for s, q in known if (q == 1) == good) for good in (True, False))
                tail = sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))
                if n == 0 or k > rate * n or tail > quality.DELTA / (len(strata) * len(quality.SIGNALS)):
                    break
                best = max(best, (bad - quality.WEIGHT * k, cutoff), key=lambda x: (x[0], x[1] or 0))
            if best[0] > 0:
                cutoffs[stratum, name] = best[1]
    return {i for i, (stratum, failed, signals) in made.items() if not failed and not any((stratum, s) in cutoffs and v > cutoffs[stratum, s] for s, v in signals.items())}


def plain_language(rows):
    """The doc_ids that the second stage keeps."""
    counts, texts = {}, Counter()
    for i, t, lang in rows:
        if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, np.zeros(language.BUCKETS))
            counts[lang] += np.bincount(language.features([t])[0], minlength=language.BUCKETS)
            texts[lang] += 1
    tables = {x: np.log((c + 0.5) / (c.sum() + language.BUCKETS / 2)) for x, c in counts.items()}
    kept = set()
    for i, t, _ in rows:
        grams = language.features([t or ""])[0]
        sums = {x: table[grams].sum() for x, table in tables.items()}
        voted = {x: s + math.log((texts[x] + 1) / (sum(texts.values()) + len(texts))) for x, s in sums.items()}
        best = max(sorted(voted), key=voted.get)
        if len(grams) and 1 / sum(math.exp(v - voted[best]) for v in voted.values()) >= 0.5 and sums[best] > -len(grams) * math.log(language.BUCKETS):
            kept.add(i)
    return kept


def plain_duplicates(rows, percent):
    """The doc_ids that the third stage keeps."""
    sets = {}
    for i, text, _ in rows:
        w = words_of(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def test_every_pipeline_stage_equals_a_plain_version(spark):
    docs = queries.table(spark, DATA, "documents")
    labels = {}
    for r in queries.table(spark, DATA, "labels").filter("quality IS NOT NULL").collect():
        labels[r.doc_id] = max(r.quality, labels.get(r.doc_id, 0))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    plain = [lambda rows: plain_quality(rows, labels), plain_language, lambda rows: plain_duplicates(rows, 80)]
    for (name, stage), expected in zip(corpus_pipeline.STAGES, plain):
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        kept = expected(rows)
        assert {r.doc_id for r in out.collect()} == kept, name
        rows, docs = [r for r in rows if r[0] in kept], docs.filter(F.col("doc_id").isin(*kept))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "packing"]
    pieces = corpus_pipeline.run(spark, DATA).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.WORDS)
    assert {p.doc_id for p in pieces} == {i for i, *_ in rows}
    for i, text, _ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted((p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i)
        assert [(s, n, zlib.crc32(ids[s : s + n])) for s, n, _ in own] == own and sum(n for _, n, _ in own) == len(ids)


ODD = [(1, "word " * 3, "en"), (2, "", "en"), (3, None, None), (4, "a long enough text of many words that are said only once here", "en"), (5, "a long enough text of many words that are said only once here", None), (5, "another rather long text of quite different words to read for all of us", "en"), (None, "some text without a number of its own that is long enough to stay", "de")]


def test_pipeline_of_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, stratum string, bad_id long, component_id long, start long"
    wide = [(*r, None, None, "k", "r", "s", 1, 2, 3) for r in ODD] + [(100 + i, " ".join(f"w{i}v{k}" for k in range(40)) + " the end", "en", "x", 1, "k", "r", "s", 1, 2, 3) for i in range(20)]
    wide.append((200, "very long text of words " * 2 + " ".join(f"long{k}" for k in range(100_000)), "en", "x", 1, "k", "r", "s", 1, 2, 3))
    marks = spark.createDataFrame([(100, 1, 0), (101, None, 0), (None, 1, 1), (100, 0, 0)], "doc_id long, quality int, toxic int")
    for name, rows in (("odd", wide), ("empty", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        marks.filter("true" if rows else "false").write.parquet(f"{folder}/labels.parquet")
        docs = queries.table(spark, folder, "documents")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == [x.split()[0] for x in schema.split(", ")], stage_name
        left = [r.doc_id for r in docs.collect()]
        assert len(left) == len(set(left)) and set(left) >= ({200, *range(100, 120)} if rows else set()) and not {1, 2, 3} & set(left)
        pieces = corpus_pipeline.run(spark, folder).collect()
        assert {p.doc_id for p in pieces} == set(left)
