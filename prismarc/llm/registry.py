"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hard_negatives, mixing, mpeg, quality, simhash, spelling, substring_words, suffixes, token_counts, vector_dups, warc
from .common import table


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_words.dedup_words(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("rate")


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.media_digests(table(spark, sf_dir, "documents"))


def op6_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay."""
    kept = quality.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", F.col("__weight").alias("log_weight"), F.col("__key").alias("sampling_key"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.with_probe(table(spark, sf_dir, "conversations")))


def op11_radix_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring": op1_substring,
        "op2_token_counts": op2_token_counts,
        "op3_mixing": op3_mixing,
        "op4_warc": warc.query,
        "op5_mpeg_audio": op5_mpeg_audio,
        "op6_string_tiling": op6_string_tiling,
        "op7_simhash": op7_simhash,
        "op8_suffix_array": op8_suffix_array,
        "op9_quality": op9_quality,
        "op10_chat": op10_chat,
        "op11_radix_selection": op11_radix_selection,
        "op12_sorted_projections": op12_sorted_projections,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE, "op4_warc": warc.ORACLE, "op10_chat": chat.ORACLE, "op11_radix_selection": hard_negatives.ORACLE, "op12_sorted_projections": vector_dups.ORACLE, "op13_spelling": spelling.ORACLE}
