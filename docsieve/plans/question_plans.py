"""A table of questions from stored history to stored turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.operators import question_run as qr
from docsieve.operators import sessions as ss
from docsieve.plans.registry import query, table, text_table
from docsieve.plans.retrieval_plans import FOUND_SQL, OVERLAP_SQL, TURNS_SQL
from docsieve.plans.screening_plans import BLOCKED_OUT, sql_blocked_by, sql_intent
from docsieve.schemas import SESSION_SCHEMA
from docsieve.session import scratch_path
from docsieve.sources import tables as tb

_NO_INTENT = ["input_length_min", "input_length_max", "pii", "injection", "toxicity"]
_MESSAGES_SQL = f"""
  SELECT session_id, turn_number, half, role, content FROM (
    SELECT session_id, turn_number, 0 AS half, 'user' AS role, user_message AS content, row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC) AS r FROM ({TURNS_SQL})
    UNION ALL SELECT session_id, turn_number, 1, 'assistant', assistant_response, row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC) FROM ({TURNS_SQL})) WHERE r <= 2 AND content <> ''"""


def _short_model():
    """Repeats the head of its prompt; to one prompt in five it adds a promise."""
    return lambda batch: batch.map(lambda p: p[:300] + (" It is a guaranteed profit." if len(p) % 5 == 0 else ""))


def _question_run(spark, sf):
    """Every benchmark text asked in the conversation of the same number, answered from the documents."""
    requests = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("thread_id"), F.concat(F.lit("user"), F.col("item_id").cast("string"), F.lit("@mail.net")).alias("user_id"), F.col("text").alias("question")
    )
    chunks = text_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("url"), F.col("text").alias("chunk_text"))
    stored = ss.turns_from_messages(table(spark, sf, "conversations"))
    return qr.question_run(requests, stored, chunks, _short_model, 5, 15, 2, {"enabled_checks": _NO_INTENT}, as_of=F.lit("2024-05-01").cast("timestamp"))


_BLOCKED_QUESTION = sql_blocked_by("text").replace(f"WHEN {sql_intent('text')} <> 'accepted' THEN 'intent' ", "")
_RUN_SQL = f"""
  WITH f AS (SELECT query_id, r AS rank, url, chunk_text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS r FROM (
      SELECT f.*, {OVERLAP_SQL} AS s FROM ({FOUND_SQL}) f JOIN benchmark b ON b.item_id = f.query_id)) WHERE r <= 5),
    c AS (SELECT query_id, count(*) AS sources, string_agg('[Source ' || rank || '] ' || url || chr(10) || chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
        string_agg(chunk_text, chr(10)) AS chunk_text FROM f GROUP BY query_id),
    h AS (SELECT session_id, count(*) AS n, string_agg(role || ': ' || content, chr(10) ORDER BY turn_number, half) AS history FROM ({_MESSAGES_SQL}) GROUP BY session_id),
    l AS (SELECT session_id, max(turn_number) AS last FROM ({TURNS_SQL}) GROUP BY session_id),
    p AS (SELECT item_id AS thread_id, 'user' || item_id || '@mail.net' AS user_id, b.text AS question, {_BLOCKED_QUESTION.replace('text', 'b.text')} AS stopped_by, sources, c.chunk_text,
        coalesce(h.n, 0) AS n, coalesce(l.last, 0) AS last,
        coalesce(history || chr(10) || chr(10), '') || coalesce(context, 'No relevant documentation found.') || chr(10) || chr(10) || 'Question: ' || b.text AS prompt
      FROM benchmark b LEFT JOIN c ON c.query_id = b.item_id LEFT JOIN h ON h.session_id = b.item_id LEFT JOIN l ON l.session_id = b.item_id),
    a AS (SELECT *, left(prompt, 300) || CASE WHEN length(prompt) % 5 = 0 THEN ' It is a guaranteed profit.' ELSE '' END AS answer FROM p),
    s AS (SELECT *, {BLOCKED_OUT} AS held_by FROM a)
  SELECT thread_id, CASE WHEN stopped_by IS NOT NULL THEN 'blocked_question' WHEN held_by IS NOT NULL THEN 'blocked_answer' ELSE 'answered' END AS status,
    coalesce(stopped_by, held_by) AS blocked_by, CASE WHEN stopped_by IS NULL AND held_by IS NULL THEN md5(answer) END AS digest,
    CAST(CASE WHEN stopped_by IS NULL THEN coalesce(sources, 0) ELSE 0 END AS INTEGER) AS sources, CAST(n AS INTEGER) AS history_messages,
    CASE WHEN stopped_by IS NULL AND held_by IS NULL THEN CAST(last + 1 AS INTEGER) END AS turn_number, left(question, 4000) AS question FROM s"""


@query("a107_question_run", f"SELECT thread_id, status, blocked_by, digest, sources, history_messages, turn_number FROM ({_RUN_SQL})")
def a107(spark, sf):
    run = _question_run(spark, sf)
    digest = F.when(F.col("status") == "answered", F.md5("response"))
    return run.select("thread_id", "status", "blocked_by", digest.alias("digest"), "sources", "history_messages", "turn_number")


@query("a107_stored_turns", f"""
  SELECT sha256(thread_id || ':' || turn_number) AS turn_id, CAST(thread_id AS VARCHAR) AS session_id, turn_number, md5(question) AS user_message, digest AS assistant_response,
    '2024-05-01T00:00:00' AS request_time, CAST(12.5 AS DOUBLE) AS response_time_ms, 'short' AS model_endpoint, 'tr-' || thread_id AS trace_id, '{{}}' AS metadata
  FROM ({_RUN_SQL}) WHERE status = 'answered'""")
def a107_stored(spark, sf):
    turns = qr.turns_to_store(
        _question_run(spark, sf), F.lit("2024-05-01T00:00:00"), F.lit(12.5), F.lit("short"), F.concat(F.lit("tr-"), "session_id"), F.lit("{}")
    )
    path = scratch_path(spark, "turns")
    tb.save_append(turns, path)
    kept = spark.read.schema(SESSION_SCHEMA).parquet(path)
    return kept.withColumns({"user_message": F.md5("user_message"), "assistant_response": F.md5("assistant_response")})
