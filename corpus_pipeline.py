"""From raw documents to packed sequences: quality rules, language, near duplicates, packing.

Every stage but the last returns the columns of its documents, whatever else they have, and works on all rows that its
predecessor kept; the last returns the pieces of the sequences. run() writes each stage's rows to the shared folder,
reads them back for the next stage and removes what the stage before had written.

Defined cases, as the operators state them: null, empty and blank texts, and texts of fewer than ten words, fail the
quality rules; documents without labels of their language are judged by the base rules only; where no language could be
learnt none is rejected; of rows that repeat a doc_id or a text one stays after the third stage, but all rows of a null
doc_id do; very long texts are worked on whole; an empty table passes as one through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from platen.llm import language, minhash, packing, quality
from platen.llm.common import Scratch
from platen.llm.queries import WORDS, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the risk-controlled cutoffs keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those learnt, with a posterior of at least a half, and explains their n-grams."""
    return language.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates."""
    return minhash.keep_one(docs, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences."""
    return packing.pack(docs, WORDS)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Training, hashing and tokenizing have no SQL form; brute-force versions of all stages are in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        scratch = Scratch(spark, name)
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        if before:
            before.remove()
        before = scratch
    return docs
