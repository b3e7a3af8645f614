"""The corpus pipeline: a list of stages, each a step of the operators in ``riskframe.llm``.

Rejected by quality rules or as toxic, a document goes; of near-duplicates one stays; what is
left is tokenised and packed. Every stage reads all that the one before kept. The two models
are learned from the stage's own documents and the table of labels. All stages but the last
return the columns of ``documents``, whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import minhash, packing, quality_rules, toxicity
from riskframe.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.filter_documents(docs, quality_rules.learn(docs, labels))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.filter_documents(docs, toxicity.learn(docs, labels))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit integers)."""
    return packing.pack(packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("toxicity", keep_clean),
    ("near_dedup", keep_one_of_each),
    ("packing", pack),
]

# The stages learn models, so SQL cannot express their rows; tests hold them against plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
