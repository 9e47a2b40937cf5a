"""Span trees and what they tell about latency, errors and calls.

``spans`` holds ``trace_id, span_id, parent_id, span_type, name, duration_ms,
status`` and, where asked for, ``tokens`` and ``output``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators.relational import hierarchy
from docsieve.operators.scale import exact_quantiles, side_by_side


def span_tree(spans: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``trace_id, span_id, parent_id, depth, children``."""
    placed = hierarchy(spans.select("trace_id", "span_id", "parent_id"), ["trace_id", "span_id"], ["trace_id", "parent_id"], max_depth)
    kids = spans.where(F.col("parent_id").isNotNull()).groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(
        F.count("*").alias("children")
    )
    return placed.join(kids, ["trace_id", "span_id"], "left").select(
        "trace_id", "span_id", "parent_id", "depth", F.coalesce("children", F.lit(0)).alias("children")
    )


def latency_by(spans: DataFrame, by: list[str]) -> DataFrame:
    return spans.groupBy(*by).agg(
        F.count("*").alias("spans"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("mean_ms")
    )


def bottlenecks(spans: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` slowest spans of each trace and their share of the trace's span time."""
    w = Window.partitionBy("trace_id").orderBy(F.col("duration_ms").desc(), "span_id")
    slow = spans.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    total = spans.groupBy("trace_id").agg(F.sum("duration_ms").alias("_total"))
    return slow.join(total, "trace_id").select(
        "trace_id", "rank", "span_id", "name", "duration_ms", (F.col("duration_ms") / F.nullif("_total", F.lit(0.0))).alias("share")
    )


def span_errors(spans: DataFrame) -> DataFrame:
    """Failed spans and spans without output, counted by type and kind of fault."""
    kind = F.when(F.col("status") == "ERROR", "failed").when(F.coalesce(F.length("output"), F.lit(0)) == 0, "empty_output")
    return spans.withColumn("fault", kind).where(F.col("fault").isNotNull()).groupBy("span_type", "fault").agg(
        F.count("*").alias("spans"), F.countDistinct("trace_id").alias("traces")
    )


def call_stats(spans: DataFrame, types: list[str]) -> DataFrame:
    """Per tool or model: calls, success rate, tokens, mean latency."""
    ok = F.when(F.col("status") == "OK", 1.0).otherwise(0.0)
    return spans.where(F.col("span_type").isin(types)).groupBy("span_type", "name").agg(
        F.count("*").alias("calls"), F.avg(ok).alias("success_rate"),
        F.sum(F.coalesce("tokens", F.lit(0))).cast("bigint").alias("tokens"), F.avg("duration_ms").alias("mean_ms"),
    )


def compare_sets(spans: DataFrame, group: Column) -> DataFrame:
    """Trace sets side by side: mean, min, max and median of the trace time, and the success rate."""
    per_trace = spans.groupBy(group.alias("trace_set"), "trace_id").agg(
        F.sum("duration_ms").alias("ms"), F.min(F.when(F.col("status") == "OK", 1.0).otherwise(0.0)).alias("ok")
    )
    base = per_trace.groupBy("trace_set").agg(
        F.count("*").alias("traces"), F.avg("ms").alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
        F.avg("ok").alias("success_rate"),
    )
    return side_by_side([base, exact_quantiles(per_trace, ["trace_set"], "ms", [0.5], ["p50_ms"])], ["trace_set"])


def failing_cases(traces: DataFrame, scorer: str) -> DataFrame:
    """Traces that a scorer failed, as rows for a regression dataset."""
    each = traces.select("trace_id", F.explode("assessments").alias("a"))
    failed = F.lower(F.col("a.feedback.value")).isin("no", "false", "fail", "failed")
    return each.where((F.col("a.assessment_name") == scorer) & failed).select(
        "trace_id", F.col("a.assessment_name").alias("scorer"), F.col("a.feedback.value").alias("value")
    )
