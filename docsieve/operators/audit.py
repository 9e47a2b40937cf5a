"""Audit tables as append-only events, and the states folded from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.schemas import EVENT_SCHEMA
from docsieve.sources.tables import evolve, save_append


def log_events(events: DataFrame, path: str) -> None:
    """Append start and end events; rows are never changed in place."""
    save_append(evolve(events, EVENT_SCHEMA), path)


def run_state(events: DataFrame, key: str = "key") -> DataFrame:
    """Latest status per run or step, its times and its duration in seconds.

    ``events`` holds ``key, event ('start' or 'end'), status, ts``; each key's
    rows combine on the map side.
    """
    start = F.min(F.when(F.col("event") == "start", F.col("ts")))
    end = F.max(F.when(F.col("event") == "end", F.col("ts")))
    state = events.groupBy(key).agg(
        F.max_by("status", F.struct(F.col("ts"), (F.col("event") == "end").alias("ended"), F.col("status"))).alias("status"),
        start.alias("start_time"), end.alias("end_time"),
    )
    seconds = F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / 1e6
    return state.withColumn("duration_seconds", seconds)


def daily_guardrail(traces: DataFrame) -> DataFrame:
    """Per day: requests, blocks before and after the model, and blocks per reason as a map.

    ``traces`` holds ``ts, pre_blocked, post_blocked, reason``.
    """
    reason = F.when(F.col("pre_blocked"), F.coalesce("reason", F.lit("unknown")))
    per_reason = traces.groupBy(F.to_date("ts").alias("day"), reason.alias("reason")).agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("pre_blocked"), 1).otherwise(0)).alias("pre"),
        F.sum(F.when(F.col("post_blocked"), 1).otherwise(0)).alias("post"),
    )
    entry = F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))
    return per_reason.groupBy("day").agg(
        F.sum("n").cast("bigint").alias("requests"), F.sum("pre").cast("bigint").alias("pre_blocks"),
        F.sum("post").cast("bigint").alias("post_blocks"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("block_reasons"),
    )


def latest(df: DataFrame, ts: str, tie: str, n: int = 10) -> DataFrame:
    """The latest ``n`` rows."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def run_report(steps: DataFrame) -> DataFrame:
    """Per run: steps, status, records and the slowest step.

    A run failed if any step failed, is running if any still runs, else completed.
    """
    failed = F.max(F.when(F.col("status") == "FAILED", 1).otherwise(0)) == 1
    running = F.max(F.when(F.col("status") == "RUNNING", 1).otherwise(0)) == 1
    slow = F.struct(F.coalesce("duration_seconds", F.lit(-1.0)), -F.col("step_order"), F.col("step_name"))
    return steps.groupBy("execution_id").agg(
        F.count("*").alias("steps"),
        F.when(failed, "FAILED").when(running, "RUNNING").otherwise("COMPLETED").alias("status"),
        F.sum(F.coalesce("records_processed", F.lit(0))).cast("bigint").alias("records"),
        F.max_by("step_name", slow).alias("slowest_step"),
        F.max("duration_seconds").alias("slowest_seconds"),
    )
