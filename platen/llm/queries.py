"""The queries of these operators: (spark, sf_dir) to a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytepairs, chat, html, itq, language, licences, minhash, packing, quality, sequences
from .common import new_dir
from .sql import ORACLES

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_itq_near_vectors(spark, sf_dir):
    return itq.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_arrow_sequences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sequences.read_documents(spark, sequences.write_sequences(docs, new_dir(spark, "sequences"), WORDS))


def op3_minhash_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op5_main_text(spark, sf_dir):
    return html.main_texts(table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark, sf_dir):
    return bytepairs.round_trip(table(spark, sf_dir, "documents"), BYTES, public_tokenizers.PATTERN)


def op7_licences(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), WORDS)


#: Both turns of the conversation that op10 adds.
SAID = "</s>[INST] ok [/INST]"


def op10_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(turns.unionByName(added)).withColumn("turns", chat.read_turns(F.col("formatted")))
    out = out.withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_mask")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    made = [op1_itq_near_vectors, op2_arrow_sequences, op3_minhash_near_duplicates, op4_language, op5_main_text, op6_byte_bpe, op7_licences, op8_quality, op9_packing, op10_chat]
    return {f.__name__: f for f in made} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
