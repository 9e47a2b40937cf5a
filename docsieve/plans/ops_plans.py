"""Inference, audit, monitoring and cost over the event log."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from docsieve.operators import audit as au
from docsieve.operators import cost as co
from docsieve.operators import inference as inf
from docsieve.operators import monitoring as mo
from docsieve.plans.registry import query, table
from docsieve.schemas import AUDIT_SCHEMAS
from docsieve.session import scratch_path
from docsieve.sources import tables as tb

AS_OF_MS = 1706572800000  # 2024-01-30 00:00:00

TS = "yyyy-MM-dd HH:mm:ss"
SQL_TS = "%Y-%m-%d %H:%M:%S"


def fmt(c: str):
    return F.date_format(c, TS).alias(c)


# ---------------------------------------------------------------- inference


def _echo_model():
    """A stand-in model: refuses texts with an @, says nothing to short ones, else echoes the length."""

    def respond(texts: pd.Series) -> pd.Series:
        out = "answer of " + texts.str.len().astype(str)
        out = out.mask(texts.str.contains("@", regex=False), "Your message contains Personal Information")
        return out.mask(texts.str.len() < 20)

    return respond


_RESPONSE_SQL = """CASE WHEN length(text) < 20 THEN NULL WHEN contains(text, '@') THEN 'Your message contains Personal Information'
    ELSE 'answer of ' || length(text) END"""
_INFER_SQL = f"SELECT doc_id, lang, text, {_RESPONSE_SQL} AS agent_response FROM documents"
_HELD_SQL = "coalesce(" + " OR ".join(f"lower(agent_response) LIKE '{p}'" for p in inf.QUARANTINE_LIKE) + ", false)"


def _inferred(spark, sf):
    return inf.batch_infer(table(spark, sf, "documents").select("doc_id", "lang", "text"), "text", _echo_model)


@query("a47_batch_infer", f"SELECT doc_id, lang, agent_response, 'COMPLETED' AS inference_status FROM ({_INFER_SQL})")
def a47(spark, sf):
    return _inferred(spark, sf).select("doc_id", "lang", "agent_response", "inference_status")


@query("a48_quarantine", f"SELECT doc_id, agent_response FROM ({_INFER_SQL}) WHERE {_HELD_SQL}")
def a48(spark, sf):
    return inf.quarantine(_inferred(spark, sf)).select("doc_id", "agent_response")


@query("a49_clean_output", f"SELECT doc_id, agent_response FROM ({_INFER_SQL}) WHERE NOT {_HELD_SQL}")
def a49(spark, sf):
    return inf.clean_output(_inferred(spark, sf)).select("doc_id", "agent_response")


@query("a50_batch_summary", f"""
  SELECT 'COMPLETED' AS status, (SELECT count(*) FROM documents) AS input_records, count(*) AS output_records,
         CAST(sum(CASE WHEN {_HELD_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS quarantined_records, CAST(12.3 AS DOUBLE) AS duration_seconds FROM ({_INFER_SQL})""")
def a50(spark, sf):
    return inf.batch_summary(table(spark, sf, "documents"), _inferred(spark, sf), 12.34)


# ---------------------------------------------------------------- audit


@query("a72_audit_tables", "SELECT CAST(event_id AS VARCHAR) AS audit_id, 'pre' AS guardrail_type, event_type AS check_name, event_type = 'error' AS blocked, CAST(9 AS INTEGER) AS n_columns FROM events")
def a72(spark, sf):
    schema = AUDIT_SCHEMAS["guardrail_audit_log"]
    rows = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("audit_id"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit("docs").alias("agent_name"), F.lit("dev").alias("environment"), F.lit("pre").alias("guardrail_type"),
        F.col("event_type").alias("check_name"), (F.col("event_type") == "error").alias("blocked"),
    )
    full = tb.evolve(rows, schema)
    return full.select("audit_id", "guardrail_type", "check_name", "blocked", F.lit(len(full.columns)).alias("n_columns"))


def _audit_rows(spark, sf):
    """Rows of all five audit tables, from events, labels and documents."""
    e, l = table(spark, sf, "events"), table(spark, sf, "labels")
    at = F.col("ts").cast("timestamp")
    text = lambda c: F.col(c).cast("string")
    run = F.expr("event_id div 8").cast("string")
    steps = e.select(
        text("event_id").alias("step_id"), run.alias("execution_id"), F.col("event_type").alias("step_name"), (F.col("event_id") % 8).cast("int").alias("step_order"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED").alias("status"), at.alias("start_time"), F.col("value").alias("duration_seconds"),
        F.get_json_object("props", "$.k").cast("bigint").alias("records_processed"), F.col("props").alias("input_params"),
    )
    return {
        "pipeline_execution_log": steps.groupBy("execution_id").agg(
            F.lit("ingest").alias("pipeline_name"), F.lit("dev").alias("environment"), F.min("start_time").alias("start_time"), F.sum("duration_seconds").alias("duration_seconds"),
            F.when(F.bool_or(F.col("status") == "FAILED"), "FAILED").otherwise("COMPLETED").alias("status"),
        ),
        "pipeline_step_log": steps,
        "deployment_events": e.where("event_type = 'purchase'").select(
            text("event_id").alias("event_id"), at.alias("timestamp"), F.lit("docs").alias("agent_name"), F.lit("prod").alias("target_environment"),
            (F.col("value") > 10).alias("evaluation_passed"), F.lit("DEPLOYED").alias("deployment_status"),
        ),
        "guardrail_audit_log": e.select(
            text("event_id").alias("audit_id"), at.alias("timestamp"), F.lit("docs").alias("agent_name"), F.lit("dev").alias("environment"), F.lit("pre").alias("guardrail_type"),
            F.col("event_type").alias("check_name"), (F.col("event_type") == "error").alias("blocked"),
        ),
        "eval_results": l.select(
            F.lit("ev-1").alias("evaluation_id"), F.col("doc_id").alias("row_index"), F.lit("docs").alias("agent_name"), F.lit("dev").alias("environment"),
            F.create_map(F.lit("quality"), F.col("quality").cast("double")).alias("scores"), F.col("toxic").cast("double").alias("toxicity_score"),
            (F.col("quality") == 1).alias("overall_passed"), F.lit("2024-02-01").cast("timestamp").alias("evaluated_at"),
        ),
    }


_AUDIT_KEYS = {
    "pipeline_execution_log": ("execution_id", "status = 'FAILED'"), "pipeline_step_log": ("step_id", "status = 'FAILED'"),
    "deployment_events": ("event_id", "evaluation_passed"), "guardrail_audit_log": ("audit_id", "blocked"), "eval_results": ("row_index", "overall_passed"),
}


@query("a72_five_audit_tables", """
  SELECT 'pipeline_execution_log' AS name, count(*) AS rows, count(DISTINCT k) AS keys, CAST(count_if(f) AS BIGINT) AS marked, 15 AS columns FROM (SELECT event_id // 8 AS k, bool_or(event_type = 'error') AS f FROM events GROUP BY 1)
  UNION ALL SELECT 'pipeline_step_log', count(*), count(DISTINCT event_id), CAST(count_if(event_type = 'error') AS BIGINT), 15 FROM events
  UNION ALL SELECT 'deployment_events', count(*), count(DISTINCT event_id), CAST(count_if(value > 10) AS BIGINT), 14 FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT 'guardrail_audit_log', count(*), count(DISTINCT event_id), CAST(count_if(event_type = 'error') AS BIGINT), 9 FROM events
  UNION ALL SELECT 'eval_results', count(*), count(DISTINCT doc_id), CAST(count_if(quality = 1) AS BIGINT), 21 FROM labels""")
def a72_five(spark, sf):
    """Every audit table appended to twice and read back by its declared columns."""
    out = []
    for name, rows in _audit_rows(spark, sf).items():
        path, (key, mark) = scratch_path(spark, name), _AUDIT_KEYS[name]
        full = tb.evolve(rows, AUDIT_SCHEMAS[name])
        for half in (0, 1):
            tb.save_append(full.where(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(2)) == half), path)
        back = spark.read.schema(AUDIT_SCHEMAS[name]).parquet(path)
        out.append(back.agg(
            F.lit(name).alias("name"), F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.sum(F.when(F.expr(mark), 1).otherwise(0)).cast("bigint").alias("marked"),
            F.lit(len(back.columns)).alias("columns"),
        ))
    return reduce(lambda a, b: a.unionByName(b), out)


# A run per 8 events and a step per event; every step starts, all but views end.
_STEPS_SQL = """
  SELECT event_id, event_id // 8 AS execution_id, event_id % 8 AS step_order, event_type AS step_name,
    CASE WHEN event_type = 'view' THEN 'RUNNING' WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status,
    ts AS start_time, CASE WHEN event_type = 'view' THEN NULL ELSE ts + to_milliseconds(CAST(floor(value * 1000) AS BIGINT)) END AS end_time,
    CASE WHEN event_type = 'view' THEN NULL ELSE floor(value * 1000) / 1000 END AS duration_seconds,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS records FROM events"""


def _step_events(spark, sf):
    e = table(spark, sf, "events")
    ms = F.floor(F.col("value") * 1000)
    start = e.select(F.col("event_id").cast("string").alias("key"), F.lit("start").alias("event"),
                     F.lit("RUNNING").alias("status"), "ts")
    end = e.where("event_type <> 'view'").select(
        F.col("event_id").cast("string").alias("key"), F.lit("end").alias("event"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED").alias("status"),
        F.timestamp_add("MILLISECOND", ms, F.col("ts")).alias("ts"),
    )
    return start.unionByName(end)


@query("a73_log_events", "SELECT event, count(*) AS n FROM (SELECT 'start' AS event FROM events UNION ALL SELECT 'end' FROM events WHERE event_type <> 'view') GROUP BY event")
def a73(spark, sf):
    path = scratch_path(spark, "audit-events")
    au.log_events(_step_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), path)
    return tb.read_merged(spark, path).groupBy("event").agg(F.count("*").alias("n"))


@query("a74_run_state", f"""
  SELECT CAST(event_id AS VARCHAR) AS key, status, strftime(start_time, '{SQL_TS}') AS start_time, strftime(end_time, '{SQL_TS}') AS end_time,
         round(duration_seconds, 3) AS duration_seconds FROM ({_STEPS_SQL})""")
def a74(spark, sf):
    out = au.run_state(_step_events(spark, sf))
    return out.select("key", "status", fmt("start_time"), fmt("end_time"), F.round("duration_seconds", 3).alias("duration_seconds"))


@query("a75_evolve", """
  SELECT conv_id, turn, CAST(NULL AS VARCHAR) AS metadata, CAST(NULL AS DOUBLE) AS response_time_ms, role FROM conversations""")
def a75(spark, sf):
    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("metadata", T.StringType()), T.StructField("response_time_ms", T.DoubleType()),
    ])
    return tb.evolve(table(spark, sf, "conversations").select("conv_id", "turn", "role"), schema)


_TRACE_SQL = """
  SELECT event_id, ts, event_type = 'error' AS pre_blocked, event_type = 'click' AND user_id % 2 = 0 AS post_blocked,
    CASE user_id % 4 WHEN 0 THEN 'pii' WHEN 1 THEN 'injection' WHEN 2 THEN 'toxicity' END AS reason FROM events"""


def _traces(spark, sf):
    """Traces with their screening tags, one per event."""
    return table(spark, sf, "events").select(
        "event_id", "ts", (F.col("event_type") == "error").alias("pre_blocked"),
        ((F.col("event_type") == "click") & (F.col("user_id") % 2 == 0)).alias("post_blocked"),
        F.when(F.col("user_id") % 4 == 0, "pii").when(F.col("user_id") % 4 == 1, "injection")
        .when(F.col("user_id") % 4 == 2, "toxicity").alias("reason"),
    )


def _tagged(spark, sf):
    t = _traces(spark, sf)
    tags = F.map_filter(
        F.create_map(
            F.lit("guardrail.pre_llm.blocked"), F.col("pre_blocked").cast("string"),
            F.lit("guardrail.post_llm.blocked"), F.col("post_blocked").cast("string"),
            F.lit("guardrail.pre_llm.blocked_by"), F.col("reason"),
        ), lambda k, v: v.isNotNull(),
    )
    return t.select(mo.epoch_ms(F.col("ts")).alias("timestamp_ms"), tags.alias("tags"))


@query("a76_daily_guardrail", f"""
  SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS requests, CAST(count_if(pre_blocked) AS BIGINT) AS pre_blocks,
    CAST(count_if(post_blocked) AS BIGINT) AS post_blocks,
    CAST(count_if(pre_blocked AND reason = 'pii') AS BIGINT) AS pii, CAST(count_if(pre_blocked AND reason IS NULL) AS BIGINT) AS unknown
  FROM ({_TRACE_SQL}) GROUP BY CAST(ts AS DATE)""")
def a76(spark, sf):
    def n(reason):
        return F.coalesce(F.element_at("block_reasons", reason), F.lit(0)).cast("bigint").alias(reason)

    return au.daily_guardrail(_traces(spark, sf)).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "requests", "pre_blocks", "post_blocks", n("pii"), n("unknown")
    )


@query("a77_latest", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def a77(spark, sf):
    return au.latest(table(spark, sf, "events"), "ts", "event_id", 10).select("event_id", "event_type")


@query("a78_run_report", f"""
  SELECT execution_id, count(*) AS steps,
    CASE WHEN bool_or(status = 'FAILED') THEN 'FAILED' WHEN bool_or(status = 'RUNNING') THEN 'RUNNING' ELSE 'COMPLETED' END AS status,
    CAST(sum(records) AS BIGINT) AS records, max(duration_seconds) AS slowest_seconds,
    first(step_name ORDER BY coalesce(duration_seconds, -1) DESC, step_order) AS slowest_step
  FROM ({_STEPS_SQL}) GROUP BY execution_id""")
def a78(spark, sf):
    e = table(spark, sf, "events")
    ended = F.col("event_type") != "view"
    steps = e.select(
        F.expr("event_id div 8").alias("execution_id"), (F.col("event_id") % 8).alias("step_order"),
        F.col("event_type").alias("step_name"),
        F.when(~ended, "RUNNING").when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETED").alias("status"),
        F.when(ended, F.floor(F.col("value") * 1000) / 1000).alias("duration_seconds"),
        F.get_json_object("props", "$.k").cast("bigint").alias("records_processed"),
    )
    return au.run_report(steps)


# ---------------------------------------------------------------- monitoring

_PAYLOAD_SQL = """
  SELECT event_id, ts, user_id, event_type, epoch_ms(ts) AS timestamp_ms, value AS response_duration_ms,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS total_tokens_count,
    CASE WHEN user_id % 3 = 0 THEN 'challenger' ELSE 'champion' END AS model_id FROM events"""


def payload(spark, sf, days: int | None = None):
    """The event log as a payload log; ``days`` back from the as-of time prune the scan."""
    events = table(spark, sf, "events")
    if days:
        since = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz") - F.expr(f"interval {days} days")
        events = events.where(F.col("ts") >= since)
    return events.select(
        "event_id", "ts", "user_id", "event_type", mo.epoch_ms(F.col("ts")).alias("timestamp_ms"),
        F.col("value").alias("response_duration_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.get_json_object("props", "$.k").cast("bigint").alias("total_tokens_count"),
        F.when(F.col("user_id") % 3 == 0, "challenger").otherwise("champion").alias("model_id"),
    )


def _payload_log(spark, sf):
    """The raw payload log: request and response as JSON text."""
    p = payload(spark, sf)
    message = lambda text: F.to_json(F.struct(F.array(F.struct(text.alias("content"))).alias("messages")))
    return p.select(
        F.col("ts").alias("request_time"), F.to_date("ts").alias("request_date"), "status_code",
        F.col("response_duration_ms").alias("execution_duration_ms"), F.col("model_id").alias("served_entity_id"),
        message(F.concat(F.lit("question \""), F.col("event_id").cast("string"), F.lit("\""))).alias("request"),
        F.when(F.col("status_code") == 200, message(F.repeat(F.lit("ab"), F.col("total_tokens_count").cast("int")))).alias("response"),
        F.col("user_id").alias("requester"),
    )


@query("a79_parse_payload", f"""
  SELECT requester, strftime(ts, '{SQL_TS}') AS request_time, status_code, response_duration_ms AS latency_ms, model_id,
    'question "' || event_id || '"' AS user_query, CAST(length('question "' || event_id || '"') AS INTEGER) AS query_length,
    CASE WHEN status_code = 200 THEN CAST(2 * total_tokens_count AS INTEGER) END AS response_length,
    CASE WHEN status_code = 200 THEN 0 ELSE 1 END AS is_error FROM (SELECT *, user_id AS requester FROM ({_PAYLOAD_SQL}))""")
def a79(spark, sf):
    return mo.parse_payload(_payload_log(spark, sf)).select(
        "requester", fmt("request_time"), "status_code", "latency_ms", "model_id", "user_query", "query_length",
        "response_length", "is_error",
    )


_OPS = """count(*) AS total_requests, round(avg(response_duration_ms), 2) AS avg_latency_ms,
    round(quantile_cont(response_duration_ms, 0.5), 2) AS p50_latency_ms, round(quantile_cont(response_duration_ms, 0.95), 2) AS p95_latency_ms,
    round(quantile_cont(response_duration_ms, 0.99), 2) AS p99_latency_ms, CAST(count_if(status_code <> 200) AS BIGINT) AS error_count,
    round(avg(total_tokens_count), 0) AS avg_tokens_per_request"""


@query("a80_op_metrics", f"SELECT {_OPS} FROM ({_PAYLOAD_SQL}) WHERE timestamp_ms > {AS_OF_MS - 24 * mo.HOUR_MS}")
def a80(spark, sf):
    return mo.op_metrics(payload(spark, sf, 1), AS_OF_MS, 24)


@query("a80_op_metrics_by_type", f"SELECT event_type, {_OPS} FROM ({_PAYLOAD_SQL}) WHERE timestamp_ms > {AS_OF_MS - 720 * mo.HOUR_MS} GROUP BY event_type")
def a80_by(spark, sf):
    return mo.op_metrics(payload(spark, sf, 30), AS_OF_MS, 720, ["event_type"])


_GUARD_WHERE = f"epoch_ms(ts) > {AS_OF_MS - 168 * mo.HOUR_MS}"


@query("a81_guardrail_metrics", f"""
  SELECT count(*) AS total_requests, CAST(count_if(pre_blocked) AS BIGINT) AS pre_llm_blocks, CAST(count_if(post_blocked) AS BIGINT) AS post_llm_blocks,
    round(count_if(pre_blocked) / count(*), 6) AS pre_llm_block_rate, round(count_if(post_blocked) / count(*), 6) AS post_llm_block_rate,
    CAST(count_if(pre_blocked AND reason = 'toxicity') AS BIGINT) AS toxicity_blocks
  FROM ({_TRACE_SQL}) WHERE {_GUARD_WHERE}""")
def a81(spark, sf):
    return mo.guardrail_metrics(_tagged(spark, sf), AS_OF_MS, 168).select(
        "total_requests", "pre_llm_blocks", "post_llm_blocks", F.round("pre_llm_block_rate", 6).alias("pre_llm_block_rate"),
        F.round("post_llm_block_rate", 6).alias("post_llm_block_rate"),
        F.coalesce(F.element_at("block_reasons", "toxicity"), F.lit(0)).cast("bigint").alias("toxicity_blocks"),
    )


@query("a81_block_reasons", f"SELECT coalesce(reason, 'unknown') AS reason, count(*) AS blocks FROM ({_TRACE_SQL}) WHERE {_GUARD_WHERE} AND pre_blocked GROUP BY 1")
def a81_reasons(spark, sf):
    return mo.block_reasons(_tagged(spark, sf), AS_OF_MS, 168)


def _drift_sql(days: int) -> str:
    recent, base = f"timestamp_ms > {AS_OF_MS - mo.DAY_MS}", f"timestamp_ms <= {AS_OF_MS - mo.DAY_MS}"
    return f"""SELECT *, abs(recent_latency - baseline_latency) / nullif(baseline_latency, 0) AS latency_drift_pct,
        abs(recent_tokens - baseline_tokens) / nullif(baseline_tokens, 0) AS token_drift_pct FROM (
      SELECT avg(response_duration_ms) FILTER ({recent}) AS recent_latency, avg(response_duration_ms) FILTER ({base}) AS baseline_latency,
             avg(total_tokens_count) FILTER ({recent}) AS recent_tokens, avg(total_tokens_count) FILTER ({base}) AS baseline_tokens
      FROM ({_PAYLOAD_SQL}) WHERE timestamp_ms > {AS_OF_MS - days * mo.DAY_MS})"""


_DRIFT_COLS = ["recent_latency", "baseline_latency", "latency_drift_pct", "recent_tokens", "baseline_tokens", "token_drift_pct"]
_DRIFT_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in _DRIFT_COLS)


def _round(df, cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("a82_drift", f"SELECT {_DRIFT_ROUND} FROM ({_drift_sql(7)})")
def a82(spark, sf):
    return _round(mo.drift(payload(spark, sf, 7), AS_OF_MS, 7), _DRIFT_COLS)


_ALERTS = "coalesce(latency_drift_pct, 0) > 0.5 AS latency_alert, coalesce(token_drift_pct, 0) > 0.25 AS token_alert"


@query("a83_drift_alerts", f"SELECT {_DRIFT_ROUND}, {_ALERTS} FROM ({_drift_sql(3)})")
def a83(spark, sf):
    return _round(mo.drift_alerts(mo.drift(payload(spark, sf, 3), AS_OF_MS, 3)), _DRIFT_COLS)


@query("a84_monitoring_cycle", f"""
  SELECT * FROM (SELECT {_OPS} FROM ({_PAYLOAD_SQL}) WHERE timestamp_ms > {AS_OF_MS - 24 * mo.HOUR_MS}),
    (SELECT count(*) AS traced_requests, CAST(count_if(pre_blocked) AS BIGINT) AS pre_llm_blocks FROM ({_TRACE_SQL}) WHERE epoch_ms(ts) > {AS_OF_MS - 24 * mo.HOUR_MS}),
    (SELECT round(latency_drift_pct, 6) AS latency_drift_pct, {_ALERTS} FROM ({_drift_sql(7)}))""")
def a84(spark, sf):
    out = mo.monitoring_cycle(payload(spark, sf, 7), _tagged(spark, sf), AS_OF_MS, 24, 7)
    return _round(out, ["latency_drift_pct"]).select(
        "total_requests", "avg_latency_ms", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "error_count",
        "avg_tokens_per_request", "traced_requests", "pre_llm_blocks", "latency_drift_pct", "latency_alert", "token_alert",
    )


def _profile_sql(unit: str) -> str:
    return f"""
    SELECT date_trunc('{unit}', ts) AS window_start, event_type AS slice, col AS "column", count(*) AS n,
      CAST(count(*) - count(v) AS BIGINT) AS nulls, min(v) AS min, max(v) AS max, avg(v) AS mean, count(DISTINCT v) AS "distinct",
      quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75
    FROM (SELECT ts, event_type, 'latency' AS col, response_duration_ms AS v FROM ({_PAYLOAD_SQL})
          UNION ALL SELECT ts, event_type, 'tokens', CASE WHEN total_tokens_count < 90 THEN CAST(total_tokens_count AS DOUBLE) END FROM ({_PAYLOAD_SQL}))
    GROUP BY 1, 2, 3"""


def _profile(spark, sf, quantiles=True):
    p = payload(spark, sf).select(
        "ts", "event_type", F.col("response_duration_ms").alias("latency"),
        F.when(F.col("total_tokens_count") < 90, F.col("total_tokens_count")).alias("tokens"),
    )
    return mo.profile(p, "ts", "1 day", ["latency", "tokens"], "event_type", quantiles)


@query("a85_profile", f"""
  SELECT strftime(window_start, '{SQL_TS}') AS window_start, slice, "column", n, nulls, min, max, round(mean, 6) AS mean, "distinct",
    round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75 FROM ({_profile_sql('day')})""")
def a85(spark, sf):
    return _round(_profile(spark, sf), ["mean", "p25", "p50", "p75"]).withColumn("window_start", fmt("window_start"))


@query("a85_profile_categories", f"""
  SELECT strftime(date_trunc('day', ts), '{SQL_TS}') AS window_start, model_id AS slice, event_type AS category, count(*) AS n
  FROM ({_PAYLOAD_SQL}) GROUP BY date_trunc('day', ts), model_id, event_type""")
def a85_categories(spark, sf):
    return mo.category_counts(payload(spark, sf), "ts", "1 day", "event_type", "model_id").withColumn("window_start", fmt("window_start"))


@query("a86_window_drift", f"""
  SELECT strftime(window_start, '{SQL_TS}') AS window_start, slice, "column", round(mean, 6) AS mean, round(p, 6) AS previous_mean,
    round(mean - p, 6) AS mean_change, round((mean - p) / nullif(abs(p), 0), 6) AS relative_change
  FROM (SELECT *, lag(mean) OVER (PARTITION BY slice, "column" ORDER BY window_start) AS p FROM ({_profile_sql('day')}))""")
def a86(spark, sf):
    out = mo.window_drift(_profile(spark, sf, quantiles=False))
    return _round(out, ["mean", "previous_mean", "mean_change", "relative_change"]).withColumn("window_start", fmt("window_start"))


@query("a86_category_drift", f"""
  WITH c AS (SELECT date_trunc('day', ts) AS w, model_id AS s, event_type AS k, count(*) AS n FROM ({_PAYLOAD_SQL}) GROUP BY 1, 2, 3),
       t AS (SELECT w, s, sum(n) AS total, lag(w) OVER (PARTITION BY s ORDER BY w) AS pw FROM c GROUP BY w, s),
       k AS (SELECT DISTINCT s, k FROM c)
  SELECT strftime(t.w, '{SQL_TS}') AS window_start, t.s AS slice, round(sum((p - q) * ln(p / q)), 6) AS psi FROM (
    SELECT t.w, t.s, greatest(coalesce(a.n / t.total, 0), 1e-4) AS p, greatest(coalesce(b.n / u.total, 0), 1e-4) AS q
    FROM t JOIN t u ON u.w = t.pw AND u.s = t.s JOIN k ON k.s = t.s
    LEFT JOIN c a ON a.w = t.w AND a.s = t.s AND a.k = k.k LEFT JOIN c b ON b.w = t.pw AND b.s = t.s AND b.k = k.k) t GROUP BY t.w, t.s""")
def a86_categories(spark, sf):
    counts = mo.category_counts(payload(spark, sf), "ts", "1 day", "event_type", "model_id")
    return _round(mo.category_drift(counts), ["psi"]).withColumn("window_start", fmt("window_start"))


_PARSED_SQL = f"SELECT model_id, response_duration_ms AS l, CASE WHEN status_code = 200 THEN 0 ELSE 1 END AS e, CASE WHEN status_code = 200 THEN 2 * total_tokens_count END AS r FROM ({_PAYLOAD_SQL})"


@query("a87_model_compare", "SELECT " + ", ".join(
    [f"{a} FILTER (model_id = '{m}') AS {m}_{n}" if n == "requests" else f"round({a} FILTER (model_id = '{m}'), 6) AS {m}_{n}"
     for m in ("champion", "challenger") for n, a in (("requests", "count(*)"), ("avg_latency_ms", "avg(l)"), ("error_rate", "avg(e)"), ("avg_response_length", "avg(r)"))]
    + [f"round({a} FILTER (model_id = 'challenger') - {a} FILTER (model_id = 'champion'), 6) AS {n}_diff"
       for n, a in (("requests", "count(*)"), ("avg_latency_ms", "avg(l)"), ("error_rate", "avg(e)"), ("avg_response_length", "avg(r)"))]
) + f" FROM ({_PARSED_SQL})")
def a87(spark, sf):
    out = mo.model_compare(mo.parse_payload(_payload_log(spark, sf)), "champion", "challenger")
    return _round(out, [c for c in out.columns if not c.endswith("_requests")])


@query("a88_assign_traffic", "SELECT served_model, count(*) AS requests FROM (SELECT CASE WHEN user_id % 100 < 70 THEN 'v1' WHEN user_id % 100 < 90 THEN 'v2' ELSE 'v3' END AS served_model FROM events) GROUP BY 1")
def a88(spark, sf):
    out = mo.assign_traffic(table(spark, sf, "events"), F.col("user_id"), {"v1": 70, "v2": 20, "v3": 10}, hashed=False)
    return out.groupBy("served_model").agg(F.count("*").alias("requests"))


@query("a89_rate_limit", f"""
  SELECT 'user' AS scope, CAST(user_id AS VARCHAR) AS key, strftime(date_trunc('hour', ts), '{SQL_TS}') AS window_start, count(*) AS requests
  FROM events GROUP BY user_id, date_trunc('hour', ts) HAVING count(*) > 1
  UNION ALL SELECT 'endpoint', event_type, strftime(date_trunc('hour', ts), '{SQL_TS}'), count(*) FROM events
  GROUP BY event_type, date_trunc('hour', ts) HAVING count(*) > 4""")
def a89(spark, sf):
    out = mo.rate_limit(table(spark, sf, "events"), "ts", "user_id", "event_type", 1, 4, "hour")
    return out.withColumn("window_start", fmt("window_start"))


# ---------------------------------------------------------------- cost

_MODELS = ["gpt-4o-mini", "GPT-4o", "eu.claude-3-haiku-20240307.v1", "gpt-4", "unheard-of", ""]


def _responses(spark, sf):
    """A response JSON per event, in four shapes of usage figures."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf, "events").withColumn("k", k)
    shape = F.col("event_id") % 4
    text = (
        F.when(shape == 0, F.format_string('{"usage":{"prompt_tokens":%d,"completion_tokens":7,"total_tokens":%d,"cached_tokens":%d}}', "k", F.col("k") + 7, F.floor(F.col("k") / 2)))
        .when(shape == 1, F.format_string('{"usage":{"prompt_tokens":%d,"completion_tokens":9,"prompt_tokens_details":{"cached_tokens":3}}}', "k"))
        .when(shape == 2, '{"choices":[]}')
    )
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("event_id") % len(_MODELS) + 1).cast("int"))
    return e.select("event_id", "ts", "user_id", model.alias("model"), text.alias("response"), F.when(shape >= 2, F.col("k").cast("int")).alias("chunks"))


def _usage(spark, sf):
    return co.token_cost(co.token_usage(_responses(spark, sf), "response", "chunks"), "model")


_USAGE_SQL = """
  SELECT event_id, ts, user_id, CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN k ELSE 0 END AS prompt_tokens,
    CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 9 ELSE CAST(floor(k * CAST(1.3 AS DOUBLE)) AS BIGINT) END AS completion_tokens,
    CASE event_id % 4 WHEN 0 THEN k // 2 WHEN 1 THEN 3 ELSE 0 END AS cached_tokens,
    CASE event_id % 4 WHEN 0 THEN k + 7 WHEN 1 THEN k + 9 ELSE CAST(floor(k * CAST(1.3 AS DOUBLE)) AS BIGINT) END AS total_tokens,
    CASE WHEN event_id % 4 < 2 OR k > 0 THEN 1 ELSE 0 END AS requests
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


@query("a90_token_usage", f"SELECT event_id, prompt_tokens, completion_tokens, cached_tokens, total_tokens, requests FROM ({_USAGE_SQL})")
def a90(spark, sf):
    return co.token_usage(_responses(spark, sf), "response", "chunks").select(
        "event_id", "prompt_tokens", "completion_tokens", "cached_tokens", "total_tokens", "requests"
    )


_RATES = {0: (0.00015, 0.0006, 0.000075), 1: (0.0025, 0.010, 0.00125), 2: (0.00025, 0.00125, 0.000125), 3: (0.0025, 0.010, 0.00125)}


def _rate_sql(i: int) -> str:
    return "CASE event_id % 6 " + " ".join(f"WHEN {m} THEN CAST({r[i]} AS DOUBLE)" for m, r in _RATES.items()) + " ELSE 0 END"


_COST_SQL = f"""
  SELECT *, {_MODELS}[event_id % 6 + 1] AS model, (greatest(prompt_tokens - cached_tokens, 0) * {_rate_sql(0)}
    + cached_tokens * {_rate_sql(2)} + completion_tokens * {_rate_sql(1)}) / 1000 AS cost_usd FROM ({_USAGE_SQL})"""


@query("a91_token_cost", f"SELECT event_id, model, round(cost_usd, 10) AS cost_usd FROM ({_COST_SQL})")
def a91(spark, sf):
    return _usage(spark, sf).select("event_id", "model", F.round("cost_usd", 10).alias("cost_usd"))


@query("a92_usage_totals", f"""
  SELECT model, strftime(day, '%Y-%m-%d') AS day, CAST(g AS INTEGER) AS level, CAST(p AS BIGINT) AS prompt_tokens, CAST(c AS BIGINT) AS completion_tokens,
    CAST(ca AS BIGINT) AS cached_tokens, CAST(t AS BIGINT) AS total_tokens, CAST(r AS BIGINT) AS requests, round(u, 10) AS cost_usd FROM (
    SELECT model, CAST(ts AS DATE) AS day, GROUPING(model, CAST(ts AS DATE)) AS g, sum(prompt_tokens) AS p, sum(completion_tokens) AS c,
      sum(cached_tokens) AS ca, sum(total_tokens) AS t, sum(requests) AS r, sum(cost_usd) AS u
    FROM ({_COST_SQL}) GROUP BY ROLLUP (model, CAST(ts AS DATE)))""")
def a92(spark, sf):
    out = co.usage_totals(_usage(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["model", "day"])
    return out.withColumn("cost_usd", F.round("cost_usd", 10))
