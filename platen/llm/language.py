"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 4).

Features are the single letters, pairs and triples of a text's lower-cased code points, every non-letter being one
boundary sign, hashed to BUCKETS. The model is fitted to at most PER_LANGUAGE different labelled rows of each language,
whole texts, those of the smallest hashes of (doc_id, text); counts are summed in Spark. Hashes above MARGIN times the
expected bound are left out before ranking, so that a ranking task gets about MARGIN * PER_LANGUAGE of them however many
rows a language has. The log-probability matrix (BUCKETS x languages) is
broadcast; a batch of texts is scored by gathering its features' rows and summing them by text.

As a filter (keep_identified) the operator also asks that the likeliest language explains a text's n-grams better than a
model to which all buckets are alike; the posterior alone only tells the learned languages from each other. Where nothing
could be learnt the filter keeps all rows.

The model takes 128 KB a language, in the driver, in each counting task and broadcast; MOST_LANGUAGES bounds it, and more
different values of ``lang`` are an error that says so.

Defined cases: a null text or one without a letter is ``und`` with score 0; equal posteriors go to the first language in
alphabetical order; repeats of a fitted row count with it, rows of a repeated doc_id with other texts are rows of their own;
very long texts are scored whole, in one piece each, with about a hundred bytes of memory a byte; with nothing to learn from
all texts are ``und``; an empty table gives no rows; a null doc_id counts as the text ''; other columns are never inputs, and
the filter keeps them whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, tune
from .hashing import bounded

BUCKETS = 1 << 15
PER_LANGUAGE, MARGIN = 1000, 4
MOST_LANGUAGES = 1000
#: Bytes of text scored at once; features take over a hundred bytes of memory for each.
PART = 1 << 20
UNKNOWN = "und"
_U = np.uint64
_MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, size=3, dtype=np.uint64) * _U(2) + _U(1)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts and the texts they belong to."""
    joined = "\0" + "\0".join(t.lower() for t in texts) + "\0"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    where = np.repeat(np.arange(len(texts)), [len(t.lower()) + 1 for t in texts])
    letter = _is_letter()[code]
    c = np.where(letter, code, 0).astype(_U)
    at = np.flatnonzero(letter)  # never the first or the last
    a, b, d = c[at - 1] * _MULTIPLIERS[0], c[at] * _MULTIPLIERS[1], c[at + 1] * _MULTIPLIERS[2]
    def bucket(x):
        return ((x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)) >> _U(64 - 15)
    grams = np.concatenate([bucket(b), bucket(a + b + _U(1)), bucket(a + b + d + _U(2))]).astype(np.int64)
    return grams, np.tile(where[at - 1], 3)


def held_out(doc_id) -> "F.Column":
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) == 0


def hash_bound(wanted: int, n: int) -> int:
    """The signed 64-bit value below which about ``wanted`` of ``n`` hashes lie; the largest one if all are wanted."""
    return min((1 << 63) - 1, (1 << 64) * wanted // max(n, 1) - (1 << 63))


def learn(docs: DataFrame, most: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (BUCKETS + 1 rows, the last being the prior's), from what isn't held out."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    known = known.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"), "text")
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not sizes:
        return [], np.zeros((BUCKETS + 1, 0))
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{len(sizes)} languages to learn, the model is made for {MOST_LANGUAGES}")
    bounds = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, hash_bound(MARGIN * most, r.n))])
    ranked = known.filter(F.col("h") <= F.element_at(bounds, F.col("lang"))).select("lang", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    upto = sorted((r.lang, r.h) for r in ranked.filter(F.col("r") <= most).groupBy("lang").agg(F.max("h").alias("h")).collect())
    languages = [lang for lang, _ in upto]
    number = {lang: k for k, lang in enumerate(languages)}
    limit = F.create_map(*[F.lit(x) for pair in upto for x in pair])

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        texts = np.zeros(len(languages), np.int64)
        for batch in batches:
            for part in bounded(batch, "text", PART):
                grams, where = features(part.column("text").to_pylist())
                lang = np.array([number[x] for x in part.column("lang").to_pylist()])
                texts += np.bincount(lang, minlength=len(languages))
                total += np.bincount(lang[where] * BUCKETS + grams, minlength=total.size).reshape(total.shape)
        flat = np.concatenate([total.reshape(-1), texts])
        at = np.flatnonzero(flat)
        release()
        yield pa.RecordBatch.from_pydict({"k": at, "n": flat[at]})

    drawn = known.filter(F.col("h") <= F.element_at(limit, F.col("lang")))
    sums = drawn.select("lang", "text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(len(languages) * (BUCKETS + 1))
    flat[sums["k"].to_numpy()] = sums["n"].to_numpy()
    counts, texts = flat[: len(languages) * BUCKETS].reshape(len(languages), BUCKETS), flat[len(languages) * BUCKETS :]
    smooth = counts + 0.5
    table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T
    return languages, np.concatenate([table, np.log((texts + 1) / (texts.sum() + len(texts)))[None, :]])


def score(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the likeliest language of each text (-1 without a letter), its posterior probability, and whether it
    explains the text better than a model to which all buckets are alike."""
    grams, where = features(texts)
    n, best = len(texts), np.full(len(texts), -1)
    if not table.shape[1] or not n:
        return best, np.zeros(n), np.zeros(n, bool)
    size = np.bincount(where, minlength=n)
    sums = np.stack([np.bincount(where, weights=table[:-1, k][grams], minlength=n) for k in range(table.shape[1])], axis=1)
    voted = sums + table[-1]
    best = np.where(size > 0, voted.argmax(axis=1), -1)
    chance = 1 / np.exp(voted - voted.max(axis=1, keepdims=True)).sum(axis=1)
    explained = sums[np.arange(n), best] > -size * np.log(BUCKETS)
    return best, np.where(size > 0, chance, 0.0), explained & (size > 0)


def _predictor(docs: DataFrame):
    languages, table = learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast((np.array([*languages, UNKNOWN], dtype=object), np.ascontiguousarray(table.astype(np.float32))))

    def predict(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        names, table = shared.value
        best, chance, explained = score([t or "" for t in texts.to_pylist()], table)
        return names[best].tolist(), chance, explained

    return predict, len(languages)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    tune(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    predict, _ = _predictor(docs)

    def run(batches):
        for batch in batches:
            for part in bounded(batch, "text", PART):
                names, chance, _ = predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(chance)], names=["doc_id", "held_out", "lang_pred", "score"])
        release()

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a posterior of at least ``least`` and explains them."""
    tune(docs.sparkSession)
    predict, learnt = _predictor(docs)
    if not learnt:
        return docs

    def run(batches):
        for batch in batches:
            for part in bounded(batch, "text", PART):
                _, chance, explained = predict(part.column("text"))
                yield part.filter(pa.array(explained & (chance >= least)))
        release()

    return docs.mapInArrow(run, docs.schema)
