"""A table of questions from stored history to stored turn: the run that a serving layer makes of one question."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import tokens
from docsieve.operators import inference, retrieval, sessions
from docsieve.operators.screening import screen_output, screen_question
from docsieve.session import cut_lineage


def thread_history(stored: DataFrame, n: int) -> DataFrame:
    """``thread_id, history, history_messages, asked_before, last_turn`` of the last ``n`` stored turns: at most ``2n`` messages a thread."""
    recent = sessions.history(stored, n).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", "role", "content"))).alias("m"))
    line = lambda m: F.concat(m["role"], F.lit(": "), m["content"])
    said = F.transform(F.filter("m", lambda m: m["role"] == "user"), lambda m: m["content"])
    last = stored.groupBy("session_id").agg(F.max("turn_number").alias("last_turn"))
    both = last.join(recent, "session_id", "left")
    return both.select(
        F.col("session_id").alias("thread_id"), F.coalesce(F.array_join(F.transform("m", line), "\n"), F.lit("")).alias("history"),
        F.coalesce(F.array_size("m"), F.lit(0)).alias("history_messages"), F.coalesce(F.array_join(said, " "), F.lit("")).alias("asked_before"), "last_turn",
    )


def question_run(
    requests: DataFrame, stored: DataFrame, chunks: DataFrame, load: Callable[[], Callable[[pd.Series], pd.Series]], k: int = 5, found: int = 15,
    history_turns: int = 10, config: dict | None = None, answer_config: dict | None = None, as_of: Column | None = None,
) -> DataFrame:
    """One row a request: ``thread_id, user_id, question, status, blocked_by, response, sources, history_messages, turn_number``.

    ``requests`` holds one row a thread with ``thread_id, user_id, question``;
    ``stored`` the turns that threads have; ``chunks`` ``id, url, chunk_text``.
    History is loaded first, so that the intent check sees what was asked
    before. Blocked questions (status ``blocked_question``) go no further. The
    others are searched, the candidates ranked anew by the words they share
    with the question, and the model (``load`` as in ``batch_infer``) gets
    history, context and question. Answers are screened against what was
    retrieved (``blocked_answer``); failed calls are ``failed``. ``turn_number``
    is the number that an answered question gets in its thread, else null.
    Screened requests and answers are written, so the model runs once a row.
    """
    past = thread_history(stored, history_turns)
    asked = requests.select("thread_id", "user_id", "question").join(past, "thread_id", "left").fillna({"history": "", "asked_before": "", "history_messages": 0, "last_turn": 0})
    asked = screen_question(asked, "question", "asked_before", config).select(
        "thread_id", "user_id", "question", "history", "history_messages", "last_turn",
        F.col("blocked").alias("stopped"), F.col("blocked_by").alias("stopped_by"), F.col("message").alias("stop_message"),
    )
    asked = cut_lineage(asked, "asked")
    going = asked.where(~F.col("stopped"))
    queries = going.select(F.col("thread_id").alias("query_id"), F.col("question").alias("query"))
    ranked = retrieval.bm25(queries, chunks, found, text="chunk_text").join(chunks.select("id", "url", "chunk_text"), "id").join(queries, "query_id")
    shared = F.size(F.array_intersect(tokens(F.col("query")), tokens(F.col("chunk_text"))))
    top = cut_lineage(retrieval.rerank(ranked, shared, k).select("query_id", "rank", "url", "chunk_text"), "top")
    context = retrieval.build_context(queries, top)
    sources = top.groupBy("query_id").agg(F.collect_list(F.struct("url", "chunk_text")).alias("retrieved"))  # at most k a question
    prompts = going.join(context.join(sources, "query_id", "left"), F.col("thread_id") == F.col("query_id")).withColumn(
        "prompt", F.concat_ws("\n\n", F.when(F.col("history") != "", F.col("history")), "context", F.concat(F.lit("Question: "), "question"))
    )
    answers = cut_lineage(inference.batch_infer(prompts.select("thread_id", "user_id", "retrieved", "prompt"), "prompt", load, as_of), "answers")
    screened = screen_output(answers, "agent_response", "user_id", "retrieved", answer_config).select(
        "thread_id", "agent_response", "inference_status", F.coalesce(F.size("retrieved"), F.lit(0)).alias("sources"),
        F.col("blocked").alias("held"), F.col("blocked_by").alias("held_by"), F.col("message").alias("held_message"),
    )
    both = asked.join(screened, "thread_id", "left")
    failed = F.col("inference_status") == "FAILED"
    status = F.when(F.col("stopped"), "blocked_question").when(failed, "failed").when(F.col("held"), "blocked_answer").otherwise("answered")
    return both.select(
        "thread_id", "user_id", "question", status.alias("status"), F.when(F.col("stopped"), F.col("stopped_by")).when(~failed, F.col("held_by")).alias("blocked_by"),
        F.when(F.col("stopped"), F.col("stop_message")).when(F.col("held") & ~failed, F.col("held_message")).otherwise(F.col("agent_response")).alias("response"),
        F.coalesce("sources", F.lit(0)).alias("sources"), "history_messages", F.when(status == "answered", F.col("last_turn") + 1).cast("int").alias("turn_number"),
    )


def turns_to_store(run: DataFrame, request_time: Column, response_time_ms: Column, model_endpoint: Column, trace_id: Column, metadata: Column) -> DataFrame:
    """The answered questions of a run as turns in the stored columns."""
    turns = run.where(F.col("status") == "answered").select(
        F.col("thread_id").alias("session_id"), "turn_number", F.col("question").alias("user_message"), F.col("response").alias("assistant_response")
    )
    return sessions.stored_turns(turns, request_time, response_time_ms, model_endpoint, trace_id, metadata)
