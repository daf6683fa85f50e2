"""The queries of the corpus operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, jaccard_join, mixing, part_codes, periodic, pii, quality, quality_compression, token_count, topk, toxicity, warc
from .common import load
from .sql import HOSTILE, SQL


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(load(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(load(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(load(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts hold control strings."""
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_examples(turns))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_hundredth(load(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_counts(load(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_compression.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_codes.with_label_errors(load(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.with_planted_runs(load(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_mix_sources, op3_byte_bpe, op4_quality_rules, op5_token_counts, op6_chat_format, op7_exact_top_k, op8_warc, op9_jaccard_join, op10_toxicity, op11_quality_compression, op12_part_codes, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
