"""From raw documents to packed sequences: rules, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codequarry.llm.alike import near_stage
from codequarry.llm.common import shared_dir
from codequarry.llm.exact_dedup import exact_dedup
from codequarry.llm.mixing import mixed_documents
from codequarry.llm.packing import packing_digests
from codequarry.llm.quality_rules import accepted, trusted_ids


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the n-gram verdict reject go."""
    return accepted(docs, trusted_ids(spark, sf_dir))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts (fingerprints that op10's vantage-point tree finds close, or shingles of five words with a similarity of 0.8 or more), the least doc_id stays."""
    return near_stage(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources; a document may come more than once, or in parts."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact duplicates", exact_duplicates),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("packing", packed),
]
#: SimHash, tokenizing and packing are beyond SQL; the operators have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, from ``documents`` through all stages. Each stage's result is written to the folder in
    spark.checkpoint.dir, so a lost executor costs part of a stage. Null and empty texts go with the quality rules; an empty table gives no pieces.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/stage-{k}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
