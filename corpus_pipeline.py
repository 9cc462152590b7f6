"""Training-text pipeline over `documents`: quality rules, near-duplicates, benchmark decontamination, secrets, subword pieces.

Each stage takes the documents that its predecessor kept and applies one operator of `perimetra.llm` to all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimetra.llm import contamination, pieces, quality, secrets, simhash

#: The model whose pieces the last stage gives; a path that all executors can read.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality.kept(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one of the least doc_id."""
    return simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lie in benchmark passages go."""
    return contamination.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the length of a text that this changes is counted anew."""
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each text, ready for training."""
    ids = pieces.encoded(docs, PIECES)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", good_quality),
    ("simhash_near_dedup", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("sentencepiece", segmented),
]

#: The stages hash, search and segment texts in ways that SQL cannot state; tests hold them against plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
