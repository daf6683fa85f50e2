"""Documents to training tokens: quality rules, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; all but the last return
the columns of documents. ``run`` writes each stage's result as Parquet into the shared folder and reads
it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoprob.llm import bpe, jaccard_join, mixing, pii, quality
from chronoprob.llm.common import cut, load


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a certified rule rejects go."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return jaccard_join.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that reveal it are replaced in the texts."""
    return pii.sanitise(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return bpe.digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: SQL can express neither the join's classes nor the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
