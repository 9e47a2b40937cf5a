"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import ann, conversation_repair, exact_dedup, jaccard_join, lexical, line_dedup, lm, mixing, packing, pii, quality, secret_scan, substring_dedup
from docsieve.session import ship_package

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SUBSTRING_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), n AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d
), k AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s : s + 19], ' ') ORDER BY doc_id, s) AS nth FROM n
), r AS (
  SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM k WHERE nth > 1) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


def _substring_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            n, cut, kept = substring_dedup.kept_words(text, spans)
            rows.append((i, n, cut, hashlib.sha256(kept).hexdigest()))
        yield _batch(rows, [pa.int64(), pa.int64(), pa.int64(), pa.string()], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


@query("op1_substring_dedup", SUBSTRING_SQL)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = substring_dedup.repeated_spans(docs)
    return substring_dedup.remove_spans(docs, spans).mapInArrow(
        _substring_digests, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    )


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", *[secret_scan.count_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"),
    )


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, count(DISTINCT doc_id) AS docs, max(doc_id) AS stays FROM k WHERE length(key) >= 20 GROUP BY key
), f AS (
  SELECT k.doc_id, pos, line, coalesce(c.docs >= 3 AND k.doc_id <> c.stays, false) AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, text, keep in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("_keep").to_pylist(), strict=True):
            n, dropped, kept = line_dedup.kept_lines(text, keep)
            rows.append((i, n, dropped, hashlib.sha256(kept.encode()).hexdigest()))
        yield _batch(rows, [pa.int64(), pa.int64(), pa.int64(), pa.string()], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


@query("op4_line_dedup", LINE_SQL)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    maps = line_dedup.keep_bitmaps(docs)
    return line_dedup.with_bitmaps(docs, maps).mapInArrow(
        _line_digests, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string"
    )


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.withColumnRenamed("id", "doc_id")


@query("op8_nearest")
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query("op9_mixing", mixing.SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_exact_dedup", exact_dedup.SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_conversation_repair", conversation_repair.SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"))


@query("op12_lexical_search", lexical.SQL)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", *[pii.count_kind(F.col("base_spans"), k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.joined(F.col("base_spans")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
    )
