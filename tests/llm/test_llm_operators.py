"""Kernels against plain versions, and defined results of odd input for every operator."""

import base64
import hashlib
import html as reference
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platen.llm import bytepairs, chat, graph, hashing, html, itq, language, licences, minhash, packing, quality, sequences, wordpieces
from platen.llm.common import Scratch, new_dir, salted_join
from platen.llm.queries import BYTES, WORDS

ODD = ["", None, "  a  b ", "ΑΣ ΣΑΣ İstanbul ŉ", "é ́x", "a\x1cb \x85 q\xa0r", "<|endoftext|> it's a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>, DON'T 123 4.5 日本語 😀😀 ﬁ", "x" * 3000, "Ünïcödé straße ÀÉ", "a. b! c?", "[/INST] </s> \\[INST]"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, cell string, bands string, words string, stratum string, h1 string"


def docs(spark, texts, langs=None):
    """A documents table with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), None, None, "r", "c", "b", "w", "s", "h") for i, t in enumerate(texts)], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def words_of(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def full():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)  # as it comes
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tiktoken_encode():
    import tiktoken

    with open(BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_word_pieces_equal_the_whole_tokenizer(full):
    t = wordpieces.load(WORDS)
    ids, begin = t.encode(pa.array(ODD), 2)
    for i, x in enumerate(ODD):
        assert ids[begin[i] : begin[i + 1]].tolist() == full(x) + [2]


def test_word_pieces_of_special_strings_and_other_files(full, tmp_path):
    import json

    plain = wordpieces.load(WORDS, False)
    plain.full.encode_special_tokens = True
    texts = ["a <|endoftext|> b", "x<|startoftext|>y"]
    ids, begin = plain.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [plain.full.encode(t, add_special_tokens=False).ids for t in texts] != [full(t) for t in texts]
    with open(WORDS, encoding="utf-8") as f:
        described = json.load(f)
    assert wordpieces.word_pattern(described)
    described["normalizer"] = {"type": "NFC"}  # upper case is kept: another tokenizer
    other = tmp_path / "other.json"
    other.write_text(json.dumps(described), encoding="utf-8")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(other))
    ids, begin = wordpieces.load(str(other)).encode(pa.array(ODD), 2)
    assert wordpieces.load(str(other)).split is None
    for i, x in enumerate(ODD):
        assert ids[begin[i] : begin[i + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids + [2]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_tokenizers_on_any_text(full, tiktoken_encode, text):
    ids, begin = wordpieces.load(WORDS).encode(pa.array([text]))
    assert ids.tolist() == full(text)
    pairs = bytepairs.load(BYTES, P.PATTERN)
    raw = pairs.encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == tiktoken_encode(text) and pairs.decode(raw) == text.encode()


def test_shingle_sets_equal_plain_sets():
    random.seed(3)
    texts = [" ".join(random.choice(["The", "cat", "sat", "é", "x" * 9]) for _ in range(random.randrange(0, 30))) for _ in range(200)] + ["a\x1cb", "A\x0bB", None, "", " "]
    got = list(hashing.shingle_sets(pa.array(texts)))
    for a in range(0, len(texts), 7):
        assert len(got[a]) == len(shingles(texts[a]))
        for b in range(len(texts)):
            assert len(np.intersect1d(got[a], got[b])) == len(shingles(texts[a]) & shingles(texts[b]))
    hashing.BLOCK, kept = 16, hashing.BLOCK
    assert all((x == y).all() for x, y in zip(got, hashing.shingle_sets(pa.array(texts))))
    hashing.BLOCK = kept


@pytest.mark.parametrize("seed", range(20))
def test_packing_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    size, places = 16, np.unique(np.concatenate([[0], np.cumsum(r.integers(1, 9, size=14))]))
    costs = r.integers(0, 6, size=len(places)).astype(float)
    pad = lambda u: 0 if u in (4, 8, 16) else size - u
    price = lambda cuts: sum(pad(int(places[b] - places[a])) + costs[b] for a, b in zip(cuts, cuts[1:]))
    f = [0.0] + [1e9] * (len(places) - 1)
    for j in range(1, len(places)):
        f[j] = min([f[i] + pad(int(places[j] - places[i])) + costs[j] for i in range(j) if places[j] - places[i] <= size], default=1e9)
    assert price(packing.best_cuts(places, costs, size)) == pytest.approx(f[-1])


def test_tail():
    assert packing.tail(3000) == [2048, 512, 256, 128, 32, 16, 8] and packing.tail(4000) == [4000] and packing.tail(4096) == [4096]


def test_safe_cutoffs_have_exact_bounds(spark):
    from math import comb

    cases = [(0, 50), (3, 100), (10, 40), (0, 0), (2, 2), (0, 1150), (0, 1151), (1, 1500), (1, 1800), (5, 3000), (9, 4000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for rate, error in ((0.005, 0.003125), (0.1, 0.05), (0.3, 0.01)):
        got = df.select("k", "n", quality.safe(F.col("k"), F.col("n"), rate, error).alias("ok")).collect()
        for r in got:
            exact = sum(comb(r.n, i) * rate**i * (1 - rate) ** (r.n - i) for i in range(r.k + 1))
            assert r.ok == (r.n > 0 and exact <= error and r.k <= rate * r.n)
    huge = spark.createDataFrame([(4000, 10**6), (4990, 10**6)], "k long, n long").select(quality.safe(F.col("k"), F.col("n"), 0.005, 0.003).alias("ok"))
    assert [r.ok for r in huge.collect()] == [True, False]


def test_components(spark):
    random.seed(1)
    links = [(i, i + 1) for i in range(40)] + [(random.randrange(100, 160), random.randrange(100, 160)) for _ in range(50)] + [(200, k) for k in range(201, 260)] + [(7, 7)]
    expected = components(300, links)
    scratch = Scratch(spark, "test")
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert got == {x: expected[x] for pair in links for x in pair if pair[0] != pair[1]}
    assert graph.components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
    out = scratch.done(spark.range(3))
    assert out.count() == 3 and not os.path.exists(scratch.root.removeprefix("file:").replace("///", "/"))


def test_salted_join(spark):
    left = spark.createDataFrame([(1, k) for k in range(500)] + [(2, 500), (None, 501), (3, 502)], "key long, v long")
    right = spark.createDataFrame([(1, "one"), (2, "two"), (9, "none")], "key long, name string")
    got = {r.v: r.name for r in salted_join(left, right, ["key"], "v").collect()}
    assert got == {**{k: "one" for k in range(500)}, 500: "two", 501: None, 502: None}


def near_texts(n, seed=5):
    """Copies with more and more changes, chains of similarity, and loners."""
    r = random.Random(seed)
    base = [[r.choice("abcdefghijklmnop") + str(r.randrange(99)) for _ in range(120)] for _ in range(4)]
    out = []
    for k in range(n):
        w = list(base[k % 4])
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out + ["alone here", "alone here", "", None, "one two three four five six", "ONE two three four five six"]


@pytest.mark.parametrize("chunk", [1024, 7])
def test_near_duplicates_equal_brute_force(spark, chunk):
    texts = near_texts(60)
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    rows = minhash.near_duplicates(docs(spark, texts), chunk=chunk).orderBy("doc_id").collect()
    assert [r.n_shingles for r in rows] == [len(s) for s in sets]
    assert [r.component_id for r in rows] == components(len(texts), links)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_odd_rows(spark):
    empty = docs(spark, ["x"]).filter("false")
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0
    df = docs(spark, ["a b c d e f", "g h i j k l"])
    df = df.union(df.filter("doc_id = 0")).union(df.filter("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long"))).union(df.filter("doc_id = 1").withColumn("doc_id", F.lit(0).cast("long")))
    rows = minhash.near_duplicates(df).collect()
    assert len(rows) == 5 and all(r.kept for r in rows if r.doc_id is None)
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id is not None} == {(0, 0), (1, 0)}
    assert minhash.keep_one(df).columns == df.columns and minhash.keep_one(df).filter("doc_id IS NOT NULL").count() == 1


def test_near_duplicates_of_long_texts_and_many_copies(spark):
    long = [f"w{k * k % 9973}x{k}" for k in range(60_000)]
    texts = [" ".join(long), " ".join(long[:-900] + ["new"] * 5), " ".join(long[::-1])] + ["one copy of many, again and again in this table"] * 300 + ["One copy of many, again and again in this table"]
    rows = minhash.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == [0, 0, 2] + [3] * 301
    assert [r.n_shingles for r in rows[:3]] == [len(shingles(t)) for t in texts[:3]]
    both = docs(spark, texts[3:]).union(docs(spark, texts[:3]))  # each of the first ids has two texts
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(both).collect()} == {(i, 0) for i in range(301)}


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(120, 16))
    x[40:80] = x[:40] + r.normal(size=(40, 16)) * 0.08
    x[80:90] = x[0]
    lab = r.integers(0, 3, size=120)
    lab[40:90] = np.concatenate([lab[:40], np.repeat(lab[0], 10)])
    rows = [(i, [float(v) for v in np.float32(x[i])], int(lab[i]), "n", "k") for i in range(120)]
    rows += [(120, None, 1, "", ""), (121, [], 1, "", ""), (122, [0.0] * 16, 1, "", ""), (123, [float("nan")] * 16, 1, "", ""), (124, rows[0][1], None, "", ""), (125, [1.0, None], 1, "", ""), (126, [1.0, 0.0], 1, "", ""), (127, [2.0, 0.0], 1, "", "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, key string")
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = [(a, b) for a in range(120) for b in range(a) if lab[a] == lab[b] and u[a] @ u[b] >= 0.93] + [(127, 126)]
    degree = np.bincount([i for pair in links for i in pair], minlength=128)
    for block in (2048, 5):
        got = itq.near_vectors(df, block=block).orderBy("vec_id").collect()
        assert [g.n_links for g in got] == degree.tolist() and [g.component_id for g in got] == components(128, links)
    assert itq.near_vectors(df.filter("false")).count() == 0


def in_cone(n, norm, seed):
    """Unit vectors whose mean has the given norm, and as many that are at cosine 0.931 to 0.96 to them."""
    r = np.random.default_rng(seed)
    x = np.concatenate([np.zeros((n, 1)), r.normal(size=(n, 63))], axis=1)
    x = norm * np.eye(64)[0] + x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(1 - norm * norm)
    w = r.normal(size=x.shape)
    w -= (w * x).sum(axis=1, keepdims=True) * x
    c = r.uniform(0.931, 0.96, (n, 1))
    return x, c * x + np.sqrt(1 - c * c) * w / np.linalg.norm(w, axis=1, keepdims=True)


@pytest.mark.parametrize("norm", [0.85, 0.94])
def test_vectors_that_share_a_direction_equal_brute_force(spark, norm):
    x = np.float32(np.concatenate(in_cone(500, norm, 3))).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    got = itq.near_vectors(df).orderBy("vec_id").collect()
    assert [g.n_links for g in got] == (near.sum(axis=1) - 1).tolist()


def vectors_of(spark, groups):
    """A table of the rows of several matrices under one label."""
    rows = [(i, v.tolist(), 1) for i, v in enumerate(v for x in groups for v in np.float32(x))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def assert_brute_force(spark, groups, **options):
    degree, links, at = [], [], 0
    for x in groups:  # vectors of different lengths don't link
        u = np.float32(x).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        i, j = np.nonzero(np.triu(u @ u.T >= 0.93, 1))
        degree += np.bincount(np.concatenate([i, j]), minlength=len(x)).tolist()
        links += list(zip((i + at).tolist(), (j + at).tolist()))
        at += len(x)
    got = itq.near_vectors(vectors_of(spark, groups), **options).orderBy("vec_id").collect()
    assert [g.n_links for g in got] == degree and [g.component_id for g in got] == components(at, links)


def test_vectors_off_centre_in_clusters_rare_and_long_equal_brute_force(spark):
    r = np.random.default_rng(8)
    assert_brute_force(spark, [r.normal(size=(1500, 64)) + 3])  # all share a direction
    centres = r.normal(size=(12, 48)) * 2
    clusters = centres[r.integers(0, 12, 900)] + r.normal(size=(900, 48)) * 0.55
    few = np.concatenate([x := r.normal(size=(6, 31)), x + r.normal(size=(6, 31)) * 0.1])
    long = np.concatenate([x := r.normal(size=(20, 5000)), x + r.normal(size=(20, 5000)) * 0.3])
    assert_brute_force(spark, [clusters, few, long, np.array([[1.0], [2.0], [-3.0]]), r.normal(size=(60, 2))], sample=256)


def test_vectors_of_repeated_ids_stay_apart(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 2.0], 1), (0, [1.0, 0.1], 1), (None, [1.0, 0.0], 1)]
    got = itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == [(0, 2, 0, True), (1, 1, 1, True), (1, 2, 0, False), (1, 2, 0, False), (2, 1, 1, False)]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_plan_follows_the_agreement_of_pairs():
    sample, (a, b) = in_cone(2048, 0.85, 1)[0], in_cone(2000, 0.85, 2)
    bits, tables, radius, rotations = itq.learn_model(sample, 10**6)
    a, b = (itq.codes_of(x, rotations, tables, bits) for x in (a, b))
    met = (itq.substrings(a, tables, bits) == itq.substrings(b, tables, bits)).any(axis=1) & ((a != b).sum(axis=1) <= radius)
    assert bits > 4 and met.mean() > 0.998
    assert ((a != np.roll(a, 1, axis=0)).sum(axis=1) <= radius).mean() < 0.01  # codes tell others apart
    assert (itq.unpack(itq.pack(a), tables, bits) == itq.substrings(a, tables, bits)).all()
    assert itq.measured_plan(10**6, [np.ones(9)]) == itq.table_plan(10**6) and itq.measured_plan(1000, [np.full(9, 0.5)])[0] == 0


def test_rotation_is_orthogonal_and_plan_grows():
    for shape in ((100, 8), (5, 8), (1, 8), (70, 300)):
        x = np.random.default_rng(0).normal(size=shape)
        m, turn = itq.learn_rotation(x, itq.principal(x), 1)
        assert np.allclose(turn.T @ turn, np.eye(min(shape[1], itq.WIDTH)))
    assert itq.table_plan(10) == (8, 16) and itq.table_plan(10**8)[0] == 19


def expected_pieces(full, texts):
    out, start = [], 0
    for i, t in enumerate(texts):
        ids = np.array(full(t) + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def test_sequences_round_trip(spark, full):
    texts = ODD * 30 + ["word and more " * 6000]
    folder = new_dir(spark, "test")
    made = sequences.write_sequences(docs(spark, texts), folder, WORDS, length=64)
    assert [tuple(r) for r in sequences.read_documents(spark, made).orderBy("doc_id").collect()] == expected_pieces(full, texts)
    ids = [i for t in texts for i in full(t) + [2]]
    for (shard, _, n), base in zip(made.shards, made.starts()):
        f = sequences.SequenceFile(f"{folder}/shard-{shard:06d}.arrow")
        own = ids[base : base + n]
        assert len(f) == -(-n // 64) and all(f.reader.get_batch(k).num_rows == sequences.BATCH for k in range(f.batches - 1))
        for k in range(len(f)):
            got, mask = f[k]
            assert got[mask].tolist() == own[k * 64 : k * 64 + 64] and len(got) == len(mask) == 64
            assert not got.flags.owndata and not mask.flags.owndata and mask.dtype == bool
        with pytest.raises(IndexError):
            f[len(f)]
    assert sequences.read_documents(spark, sequences.write_sequences(docs(spark, ["x"]).filter("false"), new_dir(spark, "none"), WORDS)).count() == 0


def test_packing_covers_every_id_once(spark, full):
    random.seed(4)
    texts = ODD * 3 + [" ".join(random.choice(["One.", "two", "three!", "four"]) for _ in range(random.randrange(3000))) for _ in range(30)] + ["word " * 20000]
    rows = packing.pack(docs(spark, texts), WORDS).orderBy("sequence_id", "offset").collect()
    spans = {}
    for r in rows:
        ids = full(texts[r.doc_id]) + [2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4"))
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, t in enumerate(texts):
        at = 0
        for start, n in sorted(spans[i]):
            assert start == at and n > 0
            at += n
        assert at == len(full(t)) + 1
    used, at = {}, None
    for r in rows:
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 4096
    padding = sum(0 if u & (u - 1) == 0 else 4096 - u for u in used.values())
    assert padding < 0.02 * sum(used.values()) and at is None
    assert packing.pack(docs(spark, ["x"]).filter("false"), WORDS).count() == 0


def test_byte_pairs_of_odd_rows(spark, tiktoken_encode):
    assert bytepairs.round_trip(docs(spark, ["x"]).filter("false"), BYTES, P.PATTERN).count() == 0
    texts = [*ODD, "aaaa" * 999, "long text, longer: " * 20_000]
    df = docs(spark, texts).withColumns({"ids_sha256": F.lit("x"), "n_tokens": F.lit("y")})
    rows = bytepairs.round_trip(df.union(df.filter("doc_id = 3")), BYTES, P.PATTERN).orderBy("doc_id").collect()
    assert len(rows) == len(texts) + 1 and rows[3] == rows[4]
    for r, t in zip([*rows[:4], *rows[5:]], texts):
        ids = tiktoken_encode(t or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_language_of_odd_rows(spark):
    texts = ["the cat and the dog are here", "der hund und die katze sind da"] * 20 + ["", None, "123 !", "katze und hund", "THE DOG"]
    rows = language.identify(docs(spark, texts, {i: "de" for i in range(1, 40, 2)})).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows[40:]] == ["und", "und", "und", "de", "en"] and [r.score for r in rows[40:43]] == [0, 0, 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    none = language.identify(docs(spark, ["a b"]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] and language.identify(docs(spark, ["x"]).filter("false")).count() == 0
    kept = language.keep_identified(docs(spark, texts, {i: "de" for i in range(1, 40, 2)}))
    assert kept.count() == 42 and kept.columns == docs(spark, ["x"]).columns
    unknown = docs(spark, texts).withColumn("lang", F.lit(None).cast("string"))
    assert language.keep_identified(unknown).count() == len(texts)  # nothing learnt, nothing rejected
    with pytest.raises(ValueError, match="languages"):
        language.learn(spark.range(9000).selectExpr("id AS doc_id", "'some text' AS text", "string(id % 3000) AS lang"))


def plain_language(rows):
    """The model and predictions of (doc_id, text, lang) rows, one n-gram at a time."""
    counts, texts = {}, Counter()
    for i, t, lang in rows:
        if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(language.features([t])[0].tolist())
            texts[lang] += 1
    total = {x: sum(c.values()) + language.BUCKETS / 2 for x, c in counts.items()}
    out = {}
    for i, t, _ in rows:
        grams = language.features([t or ""])[0].tolist()
        sums = {x: sum(math.log((c[g] + 0.5) / total[x]) for g in grams) + math.log((texts[x] + 1) / (sum(texts.values()) + len(texts))) for x, c in sorted(counts.items())}
        best = max(sums, key=sums.get)
        out[i] = (best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())) if grams else ("und", 0.0)
    return out


def test_language_equals_a_plain_version(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = docs(spark, ["the long text " * 30_000], {}).selectExpr("100000L + doc_id AS doc_id", "text", "lang")
    df = df.select("doc_id", "text", "lang").unionByName(long)
    rows = [tuple(r) for r in df.collect()]
    expected = plain_language(rows)
    for r in language.identify(df).collect():
        assert r.lang_pred == expected[r.doc_id][0] and r.score == pytest.approx(expected[r.doc_id][1], abs=1e-3)


def test_language_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(df).filter("held_out").join(df.select("doc_id", "lang"), "doc_id")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.97
    other = ["Это обычный русский текст о погоде", "zxcv qwrtp mnbvc lkjhg fdspq", "这是一个关于天气的中文文本", ""]
    more = docs(spark, other).selectExpr("1000000L + doc_id AS doc_id", "text", "CAST(NULL AS string) AS lang")
    stayed = language.keep_identified(df.select("doc_id", "text", "lang").unionByName(more))
    assert stayed.filter("doc_id >= 1000000").count() == 0 and stayed.count() == df.count()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class=site><h2>Site</h2></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id=wrap><aside>Side</aside><article class="post-%d"><header><h1>Head &amp; line</h1><span>by me</span></header><p>First <b>bold<br>line&nbsp;two</b> text text text text.
<p>Second &#233; &lt;x&gt; para.<ul><li>one<li>two</ul><form><input value=a>Send</form><!-- gone --><table><tr><td>a</td><td>b</td></tr></table>
<div class="ad-slot">Buy</div><div class="comments"><p>Reader says</p></div><script>x()</script></article></div><footer>&copy; me</footer>"""


def test_language_is_fitted_to_a_bounded_number_of_texts(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("words of text "), F.col("id")).alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("lang"))
    df = df.withColumnRenamed("id", "doc_id").repartition(4)
    languages, table = language.learn(df, most=20)
    assert languages == ["a", "b"] and np.allclose(table[-1], np.log(0.5))  # 20 of each, though one has twice the rows
    repeated = df.filter("doc_id = 0").unionByName(df.filter("doc_id = 2500")).crossJoin(spark.range(200)).drop("id")
    known = [r.doc_id for r in repeated.filter(~language.held_out("doc_id")).select("doc_id").distinct().collect()]
    assert len(language.learn(repeated, most=20)[0]) == len(known)
    assert language.hash_bound(4000, 10) == 2**63 - 1 and language.hash_bound(1, 2) == 0


def test_main_text():
    got = html.extract(PAGE % 3)
    assert got == "Head & line\n\nFirst bold line two text text text text.\n\nSecond é <x> para.\n\none\n\ntwo\n\na b"
    assert html.extract(None) == html.extract("") == "" and html.extract("plain &amp text") == "plain & text"
    assert html.extract("<p>a<p>b<div>c<span>d</span> e<") == "a\n\nb\n\ncd e"
    assert html.extract("<article>" * 3000 + "deep") == "deep" and html.extract("<div>" + "word " * 50_000).count("word") == 50_000
    assert html.vote(PAGE % 3)[0] == html.vote(PAGE % 45)[0] == "html>body>div>article.post-#"


def test_main_text_is_whole(spark):
    headed = "<body><article><h1>Title</h1><p>lead</p><div class=body><p>" + "long text " * 100 + "</p></div></article>"
    assert html.extract(headed).startswith("Title\n\nlead\n\nlong") and html.vote(headed)[0] == "html>body>article"
    embed = "<body><div class=content><p>" + "words " * 500 + "</p><article class=embed>" + "quoted " * 28 + "</article></div>"
    assert html.extract(embed).count("words") == 500 and html.extract(embed).count("quoted") == 28
    both = "<body><article><p>" + "a " * 100 + "</p></article><article><p>" + "b " * 110 + "</p></article><article><p>" + "c " * 90 + "</p></article>"
    assert [html.extract(both).count(c) for c in "abc"] == [100, 110, 90]
    nested = "<body><div>" + "<p>" + "part " * 30 + "</p><div>" + "<p>" + "part " * 28 + "</p><div>" + "<p>" + "part " * 360 + "</p></div></div></div>"
    assert html.extract(nested).count("part") >= 0.85 * 418
    assert html.vote("<body><main><article><p>" + "text " * 9 + "</p></article><nav>menu</nav></main>")[0] == "html>body>main>article"
    one = "<body><div class=body><p>" + "only part " * 20 + "</p></div><div class=more><p>x</p></div>"
    two = "<body><div class=body><p>" + "first " * 50 + "</p></div><div class=more><p>x</p></div><div class=body><p>" + "second " * 60 + "</p></div>"
    df = spark.createDataFrame([(i, "http://a.b/x", one) for i in range(3)] + [(3, "http://a.b/y", two)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(df).collect()}
    assert got[3] == ("first " * 50).strip() + "\n\n" + ("second " * 60).strip() and got[0] == ("only part " * 20).strip()


def test_words_in_classes_drop_no_article():
    article = "<h1>Head</h1>" + "<p>real text here</p>" * 40
    whole = "\n\n".join(["Head", *["real text here"] * 40])
    menu = "<div class='sidebar menu'><p>side</p></div><div id=newsletter>Subscribe</div>"
    for wrap in ("<div class='wrap has-sidebar'>%s</div>", "<div class=related-work>%s</div>", "<section id=comments-page><div class=promo>%s</div></section>", "<div class='no-sidebar'><div class=content>%s</div></div>"):
        assert html.extract("<body>" + menu + wrap % article + menu) == whole
    said = "<ul class=commentlist>" + "<li><article><p>I think so too, very much.</p></article></li>" * 400 + "</ul>"
    assert html.extract("<body><div class=post>" + article + "</div><div id=comments>" + said + "</div>") == whole


def test_sections_at_the_winning_path_all_come_back(spark):
    one = "<body><div class=section><p>" + "short page " * 9 + "</p></div>"
    three = "<body>" + "".join(f"<div class=section><p>{w} " + "words here " * 30 + "</p></div>" for w in ("one", "two", "three"))
    df = spark.createDataFrame([(i, "http://h/x", one) for i in range(4)] + [(9, "http://h/y", three)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_texts(df).collect()}
    assert [b.split()[0] for b in got[9].split("\n\n")] == ["one", "two", "three"]


def test_parsing_is_linear():
    began = time.time()
    assert html.extract("<b>" * 20_000 + "<p>text " * 2000).count("text") == 2000
    assert html.extract("<div>" * 20_000 + "<p>text " * 2000 + "</div>" * 20_000).count("text") == 2000
    assert html.extract("<li><b><i>" * 5000 + "x</td></table></a>" * 5000).count("x") == 5000
    assert time.time() - began < 3


def test_host_path_wins(spark):
    usual = "<body><div class=main><p>" + "long text here " * 20 + "</p></div><div class=extra><p>%s</p></div>"
    odd = "<body><div class=main><p>short</p></div><div class=extra><p>" + "related stories " * 30 + "</p></div>"
    rows = [(i, "http://a.b/x", usual % "more") for i in range(3)] + [(3, "http://a.b/y", odd), (4, None, "<p>x</p>"), (5, "http://c.d", None), (6, "nonsense", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("z")).withColumn("host", F.lit("z"))
    for most in (20_000, 0):
        got = {r.page_id: (r.text, r.n_chars) for r in html.main_texts(df, most).collect()}
        assert got[3] == ("short", 5) and got[4] == ("x", 1) and got[5] == got[6] == ("", 0)
    assert html.main_texts(df.filter("false")).count() == 0


def test_main_text_of_all_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    for r in html.main_texts(df).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", reference.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_licences(spark):
    mit = "\n".join(licences.SENTENCES["mit.1"][0].split(" ", 30)) + ".\n" + ". ".join(s for k in ("mit.2", "mit.3") for s in licences.SENTENCES[k]) + "."
    texts = ["Text here.\nReleased under the MIT License.", mit, "licensed under CC BY-NC 4.0", "", None, "released under the mitigated licence", "Licensed under the Apache License, Version 2.0.\nAll rights reserved."]
    rows = licences.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r.licences, r.kind) for r in rows] == [("mit", "permissive"), ("mit-text", "permissive"), ("cc-by-nc-4.0", "restricted"), ("", "none"), ("", "none"), ("", "none"), ("apache-2.0,all-rights-reserved", "restricted")]
    assert licences.scan(docs(spark, ["x"]).filter("false")).count() == 0


APACHE_NOTICE = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT_FILE = """MIT License

Copyright (c) 2020 Some Body Inc.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_FILE = """BSD License

Copyright (c) 2020, Some Body

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

%s Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

%s Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE.
"""
BSD_NAME = """3. Neither the name of %s nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
GPL_NOTICE = """A program that does things.
Copyright (C) 2020  Some Body

This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation%s either version %d of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_canonical_licence_notices(spark):
    cases = [(APACHE_NOTICE, "apache-2.0-notice", "permissive"), (MIT_FILE, "mit-text", "permissive"), (MPL_NOTICE, "mpl-2.0-notice", "copyleft")]
    cases += [(BSD_FILE % (*marks, ""), "bsd-2-text", "permissive") for marks in (("1.", "2."), ("*", "*"))]
    cases += [(BSD_FILE % ("1.", "2.", BSD_NAME % who), "bsd-3-text", "permissive") for who in ("the copyright holder", "Some Body Inc.")]
    cases += [(GPL_NOTICE % (*marks, v), f"gpl-{v}.0-notice", "copyleft") for v in (2, 3) for marks in ((";", ";"), (":", ","), (";", ","), (":", ";"))]
    cases += [(t.replace("\n", "\r\n"), *x) for t, *x in cases] + [("/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.splitlines()) + " */\n", *x) for t, *x in cases]
    cases += [(APACHE_NOTICE.replace("\n\n", "\n"), "apache-2.0-notice", "permissive"), (" ".join(APACHE_NOTICE.split("\n\n", 1)[1].split()), "apache-2.0-notice", "permissive"), (MIT_FILE.replace("\n\n", "\n"), "mit-text", "permissive")]
    rows = licences.scan(docs(spark, [t for t, *_ in cases])).orderBy("doc_id").collect()
    assert [(r.licences, r.kind) for r in rows] == [tuple(x) for _, *x in cases]
    assert all(re.search(licences.CLUES, s) for s in licences.known_in_notices())
    assert rows[0].sentence_ids == "apache.1,apache.2,apache.3,apache.4,apache.5" and rows[0].n_sentences == 5


# Wordings that were not used in making the tables.
WORDINGS = {
    "mit": ["This project is released under the MIT License", "The code in this repository is available under the terms of the MIT licence.", "mylib is MIT-style and is distributed under the MIT license - see the LICENSE file for details", "Everything here is published under an MIT license.", "// SPDX-License-Identifier: MIT", "This package is free software, licensed under the MIT license (see COPYING)."],
    "apache-2.0": ["Our SDK is licensed under the Apache License 2.0; see LICENSE.", "All samples are made available under Apache 2.0", "This library is distributed under the terms of the Apache License (Version 2.0).", "# SPDX-License-Identifier: Apache-2.0", "The tool is open sourced under the Apache v2 license"],
    "bsd": ["This module is licensed under the BSD 3-Clause License.", "Released under a 3-clause BSD license", "Distributed under the New BSD License", " * SPDX-License-Identifier: BSD-3-Clause"],
    "bsd-2-clause": ["The parser is released under the simplified BSD license.", "Available under the BSD 2-clause licence"],
    "gpl-3.0": ["This plugin is released under the GNU GPLv3", "It is licensed under the GNU General Public License v3.0 or later.", "licensed under GPL v3", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl-2.0": ["The driver is distributed under the GPLv2 license.", "This work is licensed under the terms of the GNU GPL, version 2.", "/* SPDX-License-Identifier: GPL-2.0-only */"],
    "gpl": ["The game is covered by the GNU General Public License."],
    "lgpl": ["This library is licensed under the LGPL.", "Qt parts are available under the GNU Lesser General Public License v2.1"],
    "agpl-3.0": ["The server is released under the AGPLv3."],
    "mpl-2.0": ["The addon is published under the Mozilla Public License 2.0.", "made available under MPL-2.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at the site"],
    "cc-by-4.0": ["Text and figures are licensed under CC-BY 4.0", "The course is shared under the Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Content on this site is available under CC BY-SA 4.0.", "Photos are offered under a Creative Commons Attribution-ShareAlike 4.0 licence"],
    "cc-by-nc-sa-4.0": ["Slides are released under CC BY-NC-SA 4.0"],
    "cc-by-nc-4.0": ["Data are provided under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "isc": ["The utility is distributed under the ISC License."],
    "unlicense": ["This snippet is released under the Unlicense."],
    "zlib": ["The bindings are offered under the zlib licence."],
    "cc0-1.0": ["The dataset is published under CC0."],
}
OTHERS = ["He was released under pressure by MIT staff", "The mitigation is covered by a licence fee", "They were published by Apache Press in 2001", "A BSD user is governed by the same rules", "under the circumstances the license was lost", "The film was released by a studio under a distribution license", "cc by mail", "drivers licensed under state law", "the mit students are under stress"]
ISC_FILE = """ISC License

Copyright (c) 2020, Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
ZLIB_FILE = """Copyright (c) 2020 Some Body

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
"""


def test_licence_wordings_that_were_held_out(spark):
    cases = [(t, name) for name, texts in WORDINGS.items() for t in texts] + [(t, "") for t in OTHERS]
    cases += [("Some text.\n" + t + "\nMore of it.", name) for t, name in cases]
    rows = licences.scan(docs(spark, [t for t, _ in cases])).orderBy("doc_id").collect()
    missed = [(t, name, r.licences) for (t, name), r in zip(cases, rows) if r.licences != name]
    assert len(missed) <= 0.05 * len(cases) and not [x for x in missed if not x[1]], missed


def test_licence_texts(spark):
    lesser = GPL_NOTICE % (";", ";", 3)
    texts = [ISC_FILE, ZLIB_FILE, lesser.replace("General", "Lesser General"), lesser.replace("General", "Affero General"), "word " * 200_000 + "\nReleased under the MIT License.\n"]
    rows = licences.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.licences for r in rows] == ["isc-text", "zlib-text", "lgpl-notice", "agpl-notice", "mit"]


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    r = random.Random(1)
    texts = [*ODD, "a b c d e\na b c d e\n \n\na b c d e", "# * $ % & | < >", *(" ".join(r.choice("abc") for _ in range(k)) for k in range(0, 40, 3)), *("\n".join(r.choice(["x y", "z", ""]) for _ in range(9)) for _ in range(9))]
    rows = quality.judge(docs(spark, texts), labels(spark)).orderBy("doc_id").collect()
    assert [(x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in rows] == [base_counts(t) for t in texts]
    for x in rows:
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words) and x.kept == (not x.base_failed)
    assert quality.judge(docs(spark, ["x"]).filter("false"), labels(spark)).count() == 0


def test_quality_cutoffs(spark):
    good = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(4000)]
    bad = [" ".join(f"w{i}x{k}# *" for k in range(30)) for i in range(300)]
    df = docs(spark, good + bad)
    marks = [(i, int(i < 4000), 0) for i in range(0, 4300)] + [(0, None, None), (None, 1, 0), (4000, 0, 1)]
    rows = quality.judge(df, labels(spark, marks)).collect()
    assert all(r.kept for r in rows if r.doc_id < 4000) and not any(r.kept for r in rows if r.doc_id >= 4000)
    clashing = df.union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).withColumns({c: F.lit(1) for c in ("bad_id", "bad_text", "n_words", "quality", "row", "cutoff_repeated_words", "kept")})
    out = quality.keep_good(clashing, labels(spark, marks))
    assert out.count() == 4001 and out.columns == clashing.columns
    few = quality.judge(df, labels(spark, [m for m in marks if m[0] and (m[0] < 860 or m[0] > 4000)])).collect()
    assert all(r.kept for r in few)  # with one stratum, 874 good labels are needed
    assert quality.keep_good(df.filter("false"), labels(spark)).count() == 0


def test_quality_cutoffs_hold_on_new_rows(spark):
    """False rejections stay under ALPHA in every stratum, on rows that were not used."""
    r = random.Random(2)
    word = lambda noisy: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) + ("#" if r.random() < noisy else "")
    texts, langs, marks = [], {}, []
    for i in range(7000):
        good = i % 8 > 0
        texts.append(" ".join(word(r.choice([0, 0, 0.02, 0.05]) if good else r.choice([0.02, 0.6, 1])) for _ in range(40)))
        langs[i] = "en" if i % 2 else "de"
        marks.append((i, int(good), 0))
    rows = quality.judge(docs(spark, texts, langs), labels(spark, marks[:5600])).collect()
    new = [x for x in rows if x.doc_id >= 5600]
    for lang in ("en", "de"):
        own = [x.kept for x in new if langs[x.doc_id] == lang and x.doc_id % 8]
        assert own.count(False) <= 2 * quality.ALPHA * len(own)
    assert sum(not x.kept for x in new if x.doc_id % 8 == 0) > 50


CHAT = "conv_id long, turn long, role string, text string, turns string, pieces string"


def read_back(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], CHAT)
    out = chat.format_chats(df).withColumn("t", chat.read_turns(F.col("formatted"))).withColumn("l", chat.read_loss(F.col("formatted"), F.col("loss_mask")))
    return {r.conv_id: ([tuple(t) for t in r.t], r["l"], r.formatted) for r in out.collect()}


def test_chat_odd_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "</s>[INST] \\\\[INST]\n[TURN]\n"), (1, 2, "user", ""), (1, 3, "assistant", "\n</s>\n"), (1, 4, "assistant", None), (1, 5, "tool\n[TURN]\n", "x\\"), (1, 6, None, "end"), (2, 0, "assistant", "only"), (None, 0, "user", "n"), (3, None, "user", "b"), (3, None, "user", "b"), (3, None, "user", "a")]
    got = read_back(spark, rows)
    assert got[1][0] == [(r or "", t or "") for _, _, r, t in rows[:7]] and got[1][1] == "\n</s>\n"
    assert got[2][:2] == ([("assistant", "only")], "only") and got[None][0] == [("user", "n")] and got[3][0] == [("user", "a"), ("user", "b"), ("user", "b")]
    assert read_back(spark, []) == {}


def test_chat_on_any_texts(spark):
    r = random.Random(9)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\\\\", "[TURN]", "\n", " ", "a", "[SYS]", "[BOT]", "[ROLE]", "<<SYS>>", "[", "]", "<", "é😀"]
    rows = [(c, k, r.choice(["user", "assistant", "system", "tool"]), "".join(r.choice(bits) for _ in range(r.randrange(9)))) for c in range(60) for k in range(r.randrange(1, 7))]
    got = read_back(spark, rows)
    for c in {x[0] for x in rows}:
        own = [(role, t) for k, _, role, t in rows if k == c]
        assert got[c][0] == own and got[c][1] == "".join(t for role, t in own if role == "assistant")


def test_chat_long_conversations(spark):
    r = random.Random(3)
    rows = [(c, k, r.choice(["user", "assistant"]), f"text {k} </s>" * r.randrange(3)) for c, n in ((0, 1000), (1, 86), (2, 1)) for k in range(n)] + [(3, 0, "assistant", "é</s> " * 200_000)]
    got = read_back(spark, rows)
    for c in range(4):
        own = [(role, t) for k, _, role, t in rows if k == c]
        assert got[c][0] == own and got[c][1] == "".join(t for role, t in own if role == "assistant")


def test_chat_time_grows_with_the_turns(spark):
    rows = spark.range(40_000).selectExpr("0L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'some text' AS text")
    began = time.time()
    out = chat.format_chats(rows).select(F.length("formatted").alias("n"), F.size("loss_mask").alias("m")).first()
    assert out.m == 20_000 and time.time() - began < 60
