"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of `documents`;
run() writes each result as Parquet in the shared folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import fertility, mixing, near_dedup, packing, toxicity
from recordloom.llm.text import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep."""
    return fertility.with_verdict(docs)


def toxic_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model doesn't call toxic; it is fitted on the labelled ones among docs."""
    return toxicity.harmless(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return near_dedup.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(mixing.mix_sources(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and slot."""
    return packing.pack(docs).select("doc_id", *packing.ADDED)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_removed),
    ("near_dedup", near_duplicates_removed),
    ("mixing", mixed),
    ("packing", packed),
]

#: Tokenisers, a fitted model and near-duplicate components aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
