"""From raw documents to token tables: each stage is written as Parquet and read again as the next one's documents.

Edge cases, the same in all stages: a null text is an empty one; empty texts, null doc_ids and texts of any length go through every stage; columns of any name stay as they
are, whatever a stage calls its own; rows that repeat a doc_id with another text are other documents, rows that repeat both leave the second stage as one; empty tables give
empty tables, and tables without labels reject nothing. The mix drops documents without words, as nothing can be taken of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planeframe.llm import decontaminate, mixing, neardup, sst, toxicity
from planeframe.llm.common import new_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as the mix takes them."""
    return mixing.mixed_documents(docs)


def write_token_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted string tables, read back as one row for each document."""
    return sst.token_tables(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("token_tables", write_token_tables),
]

#: The string-kernel machine cannot be expressed in SQL; tests/llm/test_pipeline.py holds the other stages against brute force, and this one against its model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
