"""A training-data pipeline over ``documents``: filter, deduplicate, mix and pack.

Each stage takes the rows its predecessor kept and returns the columns of
``documents``, except the last, which returns packed pieces. A stage on an
empty table returns an empty one; nulls and ties are treated as its operator
says. Rows are only dropped by a stage's own decision: low quality, toxicity,
near copies, and what the mix does not take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import mixing, packing, quality, simhash, toxicity
from sightline.llm.queries import quality_model, toxicity_model
from sightline.session import durable


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    return quality.kept_rows(docs, quality_model(spark, sf_dir))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3."""
    return toxicity.kept_rows(docs, toxicity_model(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: 5-word shingles, similarity 0.8."""
    return simhash.one_per_group(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes: documents repeated, kept, cut at the ends of a run, or left out."""
    return mixing.mixed_documents(docs)


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("toxicity", toxicity_filter),
    ("simhash_dedup", near_dedup),
    ("mixing", source_mix),
    ("packing", best_fit_pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
