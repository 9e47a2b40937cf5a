"""The corpus pipeline: reject poor documents, drop repeated lines, keep one of each group of near copies, mix sources, pack.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the session's shared folder and gives it to the next
stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.llm import jaccard_join, line_dedup, mixing, packing, quality
from docsieve.session import cut_lineage, ship_package


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents predicted to be poor go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: repeated lines go; ``n_chars`` follows the text. Every document stays, if need be empty."""
    return line_dedup.without_lines(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 at five words and a similarity of 0.8: of each group of near copies the smallest id stays."""
    return jaccard_join.keep_one(docs, size=5, threshold=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: whole documents, none, once or twice, as their source's budget asks; rows repeat."""
    return mixing.repeat_taken(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: a row for each piece with its sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", reject_poor),
    ("line_dedup", drop_lines),
    ("near_duplicates", one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted classifier and a tokenizer are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
