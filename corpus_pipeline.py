"""From raw documents to packed sequences: quality rules, toxicity, near-duplicate join, mixing, packing.

Every stage works on what the stage before it kept, written as Parquet and read again. The first four return the columns of
the documents; a document that the mix takes twice appears twice from there on. The last returns the pieces of all documents
with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import mixing, ngram_join, packing, quality_rules, toxicity
from frameloom.llm.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; learned from the labelled documents that are left."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", civil),
    ("ngram_join", one_of_each),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
