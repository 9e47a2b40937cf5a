"""Cleaning, chunking and the difference between two chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions import text as tx

STRATEGIES = {"fixed": tx.fixed_chunks, "sentence": tx.sentence_chunks, "semantic": tx.semantic_chunks}

# Default chunking.
CHUNK_SIZE, CHUNK_OVERLAP, MIN_CHUNK = 1000, 200, 50


def clean_html(df: DataFrame, col: str, out: str = "text") -> DataFrame:
    return df.withColumn(out, tx.clean_html(F.col(col)))


def chunk(
    df: DataFrame, text: str, strategy: str = "sentence", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk: ``df``'s other columns, ``chunk_index`` from 0, ``chunk_text``."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy}; choose from {list(STRATEGIES)}")
    others = [c for c in df.columns if c != text]
    pieces = STRATEGIES[strategy](F.col(text), size, overlap)
    return df.select(*others, F.posexplode(pieces).alias("chunk_index", "chunk_text"))


def build_chunks(
    docs: DataFrame, url: str = "url", text: str = "text", strategy: str = "sentence", size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP, min_size: int = MIN_CHUNK, is_html: bool = True,
) -> DataFrame:
    """The chunk table ``url, chunk_id, chunk_index, chunk_text``.

    Indexes are given before short chunks are dropped, so gaps are normal.
    """
    body = tx.clean_html(F.col(text)) if is_html else F.col(text)
    pieces = chunk(docs.select(F.col(url).alias("url"), body.alias("body")), "body", strategy, size, overlap)
    kept = pieces.where(F.length("chunk_text") >= min_size)
    return kept.select("url", F.concat_ws("_", "url", "chunk_index").alias("chunk_id"), "chunk_index", "chunk_text")


def sync_changes(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, change`` for rows inserted, updated or deleted between two snapshots.

    Only the key and a digest of the payload are shuffled, never the text.
    """
    def digest(df: DataFrame, name: str) -> DataFrame:
        payload = F.struct(*[c for c in sorted(new.columns) if c != key])
        return df.select(key, F.sha2(F.to_json(payload), 256).alias(name))

    both = digest(old, "_old").join(digest(new, "_new"), key, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete")
        .when(F.col("_old") != F.col("_new"), "update")
    )
    return both.select(key, change.alias("change")).where(F.col("change").isNotNull())
