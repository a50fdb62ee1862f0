"""Cleaning a corpus, stage by stage: language, quality, exact copies, near copies, packing.

Each stage works on all documents that the one before kept. A filtering stage returns the columns of documents; the last one
returns where each piece of a document's tokens lies in the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stagebook.llm import dedup, language, quality, similarity, tokens
from stagebook.llm.common import materialize
from stagebook.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language is not predicted with a score of 0.5 or more."""
    return language.keep_identified(docs)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a quality score under 0.3."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest stays, then that of the smallest id."""
    return dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by a similarity of 0.8 the one of the smallest id stays."""
    return similarity.drop_similar(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return tokens.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), size=2048, end_id=0)


STAGES = [
    ("language", identify_language),
    ("quality", judge_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Predictions and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
