"""From raw documents to packed sequences, in stages that are written and reread as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagframe.llm import common, jaccard, packing, pii, quality, suffixes


def counted(docs: DataFrame) -> DataFrame:
    """n_chars follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality.keep(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word 5-grams one stays; passages of over 50 words that these still share are cut out."""
    since = len(common.STAGED)
    docs = common.stage(jaccard.representatives(docs), "representatives")
    common.drop_staged(spark, since, 1)
    docs = suffixes.remove_passages(docs, words=51)
    common.drop_staged(spark, since, 1)  # the representatives
    return counted(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that occur twice are cut out."""
    return counted(suffixes.remove(docs, length=400))


def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced."""
    return counted(pii.sanitise(docs))


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("pii_sanitisation", pii_sanitisation),
    ("harmonic_packing", harmonic_packing),
]

#: SQL expresses neither components, nor repeated bytes, nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    since = len(common.STAGED)
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
        common.drop_staged(spark, since, 1)  # what the stage wrote for itself, and the table before it
    return STAGES[-1][1](spark, docs, sf_dir)
