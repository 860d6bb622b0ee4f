"""Quality rules with risk-controlled thresholds, in Spark expressions only (operator 8).

Base rules fail texts that are too short or repeat themselves. Beyond them each signal of SIGNALS has a grid of cutoffs;
a text above the cutoff of its stratum (its language) is rejected. Cutoffs come from labelled documents that pass the
base rules: for each stratum, signal and cutoff the good documents that it would reject are counted (k of n). A cutoff is
safe if the exact binomial (Clopper-Pearson) upper bound of its false-rejection rate is at most ALPHA / (number of
signals), which is so if P(X <= k) at that rate is at most the error allowed. Cutoffs of a signal are tested from the
loosest on until one fails; as k only grows on the way, such a fixed sequence needs no correction within itself, and
all sequences (strata x signals) share DELTA equally (Bonferroni), so that all bounds hold at once with confidence
1 - DELTA. Of the safe cutoffs the one is used that rejects most labelled bad documents, a good one counting against
WEIGHT bad ones (of equals the highest); where none gains anything, the signal rejects nothing in that stratum. The
false rejections of a stratum's cutoffs together thus stay under ALPHA. With four strata a stratum needs at least 1151
good labelled documents, none of them rejected, for its first cutoff; with fewer only the base rules reject there.

Cutoffs are a table of one row a stratum, joined to the documents by broadcast only up to STRATA of them. Labelled
documents are counted first, so the pass over all documents filters them where they are.

Defined cases: a null text has no words; a null language is a stratum of its own, with the empty one; an unlabelled
stratum rejects by the base rules only, as do all where labels are empty; of repeated labels of a document the highest
quality counts; null qualities and null doc_ids of labels are ignored; each row of a repeated doc_id is judged by its
own text; a signal of exactly the cutoff is kept; very long texts are counted whole; empty documents give no rows;
other columns are kept by keep_good, whatever their names, and ignored otherwise.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small

WORD, NOT_WORD = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
ALPHA, DELTA, WEIGHT = 0.02, 0.05, 10
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Labelled ids and strata that are broadcast; more of them are joined by shuffling.
LABELLED, STRATA = 1_000_000, 10_000
#: Cutoffs tried for each signal (fixed values).
SIGNALS = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0),
    "duplicate_lines": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "repeated_words": (0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.125, 0.15, 0.175, 0.2),
    "mean_word_length": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0, 50.0),
}


def _windows(words: Column) -> Column:
    """Hashes of the windows of five words, in order."""
    five = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])
    return F.when(F.size(words) < 5, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - 5), five))


def _covered(windows: Column) -> Column:
    """Words in windows found twice or more, where there are any: windows are sorted with their places, equal neighbours
    give the places, and sorted places give the words, each counted once."""
    pair = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.array_sort(pair)
    hs = F.transform(ordered, lambda x: x["h"])
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(hs, F.lit(1), F.size(hs) - 1))
    after = F.concat(F.slice(hs, F.lit(2), F.size(hs) - 1), F.array(F.lit(None).cast("bigint")))
    zipped = F.arrays_zip(ordered.alias("x"), before.alias("b"), after.alias("a"))
    again = F.filter(zipped, lambda z: F.coalesce(z["x"]["h"] == z["b"], F.lit(False)) | F.coalesce(z["x"]["h"] == z["a"], F.lit(False)))
    places = F.sort_array(F.transform(again, lambda z: z["x"]["i"]))
    end = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))

    def step(s, i):  # the window at i covers i to i + 4
        return F.struct((i + 4).alias("end"), (s["n"] + F.least(F.lit(5), i + 4 - s["end"])).alias("n"))

    return F.aggregate(places, end, step, lambda s: s["n"])


COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def counts(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The columns ``carried``, the stratum and the base counts of every row of (text, lang, *carried)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(*carried, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    base = base.withColumn("words", F.filter(F.split("text", NOT_WORD), lambda w: w != ""))
    base = base.withColumn("windows", _windows(F.col("words")))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    found = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(some, _covered(F.col("windows"))).otherwise(F.lit(0)),
    }
    # generated rather than projected: filters on the counts aren't pushed below, where each word would be split off anew
    return base.select(*carried, "stratum", F.inline(F.array(F.struct(*[x.cast("long").alias(name) for name, x in found.items()]))))


def _signals() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "duplicate_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
        "mean_word_length": F.col("word_chars") / words,
    }


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def safe(k: Column, n: Column, rate: float, error: float) -> Column:
    """Whether P(X <= k) <= error for X binomial of n trials at ``rate``: the exact upper bound of the rate is at most it."""
    odds = math.log(rate) - math.log1p(-rate)
    first = F.struct((n * math.log1p(-rate)).alias("term"), (n * math.log1p(-rate)).alias("total"))

    def step(s, i):  # logarithms of the i-th term and of the sum so far
        term = s["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (F.greatest(s["total"], term) + F.log1p(F.exp(-F.abs(s["total"] - term)))).alias("total"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when((n == 0) | (k > rate * n), False).otherwise(F.aggregate(terms, first, step, lambda s: s["total"]) <= math.log(error))


def calibrate(known: DataFrame, scratch: Scratch, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each stratum: its name and the cutoff of each signal, null where there is none. ``known`` has the
    stratum, the base counts and the quality of labelled documents."""
    good = F.col("quality") == 1
    aggregates = [F.count_if(good).alias("n")]
    for name, value in _signals().items():
        each = [F.struct(F.lit(c).alias("cutoff"), F.count_if(good & (value > c)).alias("good"), F.count_if(~good & (value > c)).alias("bad")) for c in SIGNALS[name]]
        aggregates.append(F.array(*each).alias(name))
    seen = scratch.written(known.filter(~failed()).groupBy("stratum").agg(*aggregates), "seen")
    error = delta / (max(1, seen.count()) * len(SIGNALS))

    def chosen(name: str) -> Column:
        gains = F.transform(F.filter(name, lambda x: safe(x["good"], F.col("n"), alpha / len(SIGNALS), error)), lambda x: F.struct((x["bad"] - WEIGHT * x["good"]).alias("gain"), x["cutoff"].alias("cutoff")))
        best = F.array_max(F.filter(gains, lambda x: x["gain"] > 0))
        return best["cutoff"].alias(f"cutoff_{name}")

    return scratch.written(seen.select("stratum", *[chosen(name) for name in SIGNALS]), "cutoffs")


def _verdict() -> Column:
    """Whether a row with the base counts and its stratum's cutoffs is kept; one expression, which is evaluated where both meet."""
    above = [F.coalesce(value > F.col(f"cutoff_{name}"), F.lit(False)) for name, value in _signals().items()]
    return F.when(failed(), False).otherwise(~reduce(or_, above))


def _qualities(labels: DataFrame) -> DataFrame:
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    return small(known, LABELLED)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, stratum, the base counts, base_failed and kept of every row."""
    scratch = Scratch(docs.sparkSession, "quality")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    made = scratch.written(counts(named, ["doc_id"]), "counts")
    cutoffs = calibrate(made.join(_qualities(labels), "doc_id"), scratch, alpha, delta)
    out = made.join(small(cutoffs, STRATA), "stratum", "left")
    return scratch.done(out.select("doc_id", "stratum", *COUNTS, failed().alias("base_failed"), _verdict().alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept. One pass over all rows, after one over the labelled ones."""
    scratch = Scratch(docs.sparkSession, "quality")
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(_qualities(labels), "doc_id")
    known = scratch.written(counts(marked, ["quality"]), "known")
    cutoffs = scratch.done(calibrate(known, scratch, alpha, delta))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = counts(whole.select("row", F.col("row.text").alias("text"), F.col("row.lang").alias("lang")), ["row"])
    return judged.join(small(cutoffs, STRATA), "stratum", "left").filter(_verdict()).select("row.*")
