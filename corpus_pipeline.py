"""Corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and is
written as Parquet and read again as the next one's ``docs``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm import bpe, decontaminate, quality_rules, repeats, similar
from tesseral.llm.common import new_path, table

#: Near-duplicates share this much of their five-word shingles.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
RANKS = "byte_bpe_50k.tiktoken"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base thresholds or a learned rule reject go."""
    return quality_rules.filter_documents(docs, quality_rules.learn_from(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates stays."""
    return similar.keep_one(docs, NEAR_WORDS, NEAR_SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte windows that an earlier document has too are cut out of the text; n_chars follows."""
    out = repeats.keep_first(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
