"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on everything the stage before
kept and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.exact_dedup import drop_exact_duplicates
from sedimenta.llm.mixing import mixed
from sedimenta.llm.packing import pack
from sedimenta.llm.quality import keep_good
from sedimenta.llm.registry import SOURCE_WEIGHTS
from sedimenta.llm.simhash import drop_near_duplicates
from sedimenta.llm.storage import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from ``labels``."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked, directly or not, by fingerprints or by similar texts the one with the least id stays."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources' target weights interleave them: files by name, rows within them."""
    return mixed(docs, SOURCE_WEIGHTS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in sequences of 2,048 tokens, chunks of which follow the slots of the mixture.

    Readers deal files by size, so the order is made anew: partitions ascend by slot and sequence ids by partition.
    """
    return pack(mixed(docs, SOURCE_WEIGHTS))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixture", mixture), ("packing", packing)]

#: Fingerprints, tokens and the fitted classifier are beyond SQL; a test runs the same stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
