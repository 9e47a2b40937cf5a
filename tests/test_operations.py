"""Inference, monitoring, cost, audit."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsieve.operators import audit as au
from docsieve.operators import cost as co
from docsieve.operators import inference as inf
from docsieve.operators import monitoring as mo
from docsieve.schemas import AUDIT_SCHEMAS, EVENT_SCHEMA
from docsieve.sources import tables as tb


def test_inference(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("this is Blocked", 3), ("Safety content filter", 4)], "q string, p int")

    def load():
        return lambda s: s.map(lambda x: x if x is None else x, na_action="ignore").astype(object)

    out = inf.batch_infer(df, "q", load, F.lit("2024-01-01").cast("timestamp"))
    assert out.columns == ["q", "p", "agent_response", "inference_timestamp", "inference_status"]
    assert sorted(r.p for r in inf.quarantine(out).collect()) == [3, 4]
    assert sorted(r.p for r in inf.clean_output(out).collect()) == [1, 2]  # a missing response is kept
    s = inf.batch_summary(df.union(df), out, 3.21).first()
    assert (s.input_records, s.output_records, s.quarantined_records, s.duration_seconds) == (8, 4, 2, 3.2)
    empty = inf.batch_summary(df.where("false"), out.where("false"), 3.21).first()
    assert (empty.status, empty.input_records, empty.quarantined_records, empty.duration_seconds) == ("COMPLETED", 0, 0, 0.0)
    assert isinstance(load()(pd.Series(["x"])), pd.Series)


def test_a_failing_row_is_kept(spark):
    df = spark.createDataFrame([("a", 1), ("bad", 2), ("c", 3)], "q string, p int").coalesce(1)

    def load():
        def model(s):
            if (s == "bad").any():
                raise ValueError("no answer")
            return s.str.upper()

        return model

    got = {r.p: (r.agent_response, r.inference_status) for r in inf.batch_infer(df, "q", load).collect()}
    assert got == {1: ("A", "COMPLETED"), 2: ("ERROR: no answer", "FAILED"), 3: ("C", "COMPLETED")}


def test_a_model_sees_every_row_once_and_few_bytes_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(inf, "MODEL_BYTES", 1000)
    df = spark.createDataFrame([("é" * 50, i) for i in range(300)] + [("x" * 5000, 300), (None, 301)], "q string, p int").coalesce(1)
    asked, most = spark.sparkContext.accumulator(0), 10

    def load():
        def model(s):
            asked.add(len(s))
            out = s.str.len().map(lambda n: f"{n:.0f}", na_action="ignore").astype(object)
            return out if len(s) <= most else out.mask(out.notna(), "too many")

        return model

    got = {r.p: r.agent_response for r in inf.clean_output(inf.batch_infer(df, "q", load)).select("p", "agent_response").collect()}
    assert got == {**{i: "50" for i in range(300)}, 300: "5000", 301: None}
    assert asked.value == 302


def test_models_of_other_types(spark):
    df = spark.createDataFrame([([1, 2],), ([3],)], "q array<int>")
    assert sorted(r.agent_response for r in inf.batch_infer(df, "q", lambda: lambda s: s.map(len).astype(str)).collect()) == ["1", "2"]


AS_OF = 100 * mo.DAY_MS


def payload(spark, rows):
    return spark.createDataFrame(rows, "timestamp_ms long, response_duration_ms double, status_code int, total_tokens_count long")


def test_op_metrics_window(spark):
    rows = [(AS_OF - mo.HOUR_MS, 999.0, 500, 1), (AS_OF - mo.HOUR_MS + 1, 10.0, 200, 4), (AS_OF, 20.0, 404, 6)]
    r = mo.op_metrics(payload(spark, rows), AS_OF, 1).first()
    assert (r.total_requests, r.avg_latency_ms, r.p50_latency_ms, r.error_count, r.avg_tokens_per_request) == (2, 15.0, 15.0, 1, 5.0)
    r = mo.op_metrics(payload(spark, rows), AS_OF + mo.DAY_MS, 1).first()
    assert r.total_requests == 0 and r.p99_latency_ms is None and r.error_count == 0


def test_drift(spark):
    day = mo.DAY_MS
    base = [(AS_OF - 3 * day, 100.0, 200, 10), (AS_OF - day, 100.0, 200, 10), (AS_OF - 7 * day, 5000.0, 200, 9999)]
    r = mo.drift_alerts(mo.drift(payload(spark, base + [(AS_OF - day + 1, 151.0, 200, 12)]), AS_OF)).first()
    assert r.latency_drift_pct == pytest.approx(0.51) and r.token_drift_pct == pytest.approx(0.2)
    assert r.latency_alert and not r.token_alert
    r = mo.drift_alerts(mo.drift(payload(spark, [(AS_OF - 2 * day, 0.0, 200, 0), (AS_OF, 5.0, 200, 5)]), AS_OF)).first()
    assert r.latency_drift_pct is None and not r.latency_alert  # zero baseline
    r = mo.drift_alerts(mo.drift(payload(spark, base), AS_OF)).first()
    assert r.recent_latency is None and not r.latency_alert  # nothing recent


def test_guardrail_metrics(spark):
    rows = [(AS_OF, {"guardrail.pre_llm.blocked": "true", "guardrail.pre_llm.blocked_by": "pii"}), (AS_OF, {"guardrail.pre_llm.blocked": "true"}),
            (AS_OF, {"guardrail.post_llm.blocked": "true"}), (AS_OF, {}), (AS_OF, None), (0, {"guardrail.pre_llm.blocked": "true"})]
    t = spark.createDataFrame(rows, "timestamp_ms long, tags map<string,string>")
    r = mo.guardrail_metrics(t, AS_OF).first()
    assert (r.total_requests, r.pre_llm_blocks, r.post_llm_blocks) == (5, 2, 1)
    assert r.block_reasons == {"pii": 1, "unknown": 1} and r.pre_llm_block_rate == 0.4
    r = mo.guardrail_metrics(t, AS_OF * 3).first()
    assert (r.total_requests, r.block_reasons, r.pre_llm_block_rate) == (0, {}, None)


def test_traffic(spark):
    df = spark.range(1000)
    with pytest.raises(ValueError):
        mo.assign_traffic(df, F.col("id"), {"a": 50, "b": 40})
    n = {r.served_model: r["count"] for r in mo.assign_traffic(df, F.col("id"), {"a": 90, "b": 10, "c": 0}).groupBy("served_model").count().collect()}
    assert set(n) == {"a", "b"} and 850 < n["a"] < 950


def test_category_drift_new_and_gone(spark):
    rows = [("2024-01-01", "a")] * 4 + [("2024-01-02", "b")] * 4
    df = spark.createDataFrame(rows, "d string, c string").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    got = mo.category_drift(mo.category_counts(df, "ts", "1 day", "c")).collect()
    assert len(got) == 1 and got[0].psi > 10


def usage(spark, rows):
    df = spark.createDataFrame([(i, m, None if r is None else json.dumps(r), n) for i, (m, r, n) in enumerate(rows)], "i int, model string, response string, chunks int")
    return [r for r in co.token_cost(co.token_usage(df, "response", "chunks"), "model").orderBy("i").collect()]


def test_usage_and_cost(spark):
    got = usage(spark, [
        ("gpt-4o", {"usage": {"prompt_tokens": 1000, "completion_tokens": 100, "total_tokens": 1100, "cached_tokens": 400}}, None),
        ("GPT-4o", {"usage": {"prompt_tokens": 1000, "completion_tokens": 100, "prompt_tokens_details": {"cached_tokens": 400}}}, None),
        ("my-gpt-4o-mini-x", {"usage": {"prompt_tokens": 10}}, None),
        ("unknown", {"usage": {"prompt_tokens": 10, "cached_tokens": 30}}, None),
        ("", {"usage": {"prompt_tokens": 10}}, None), (None, None, 10), ("gpt-4o", {"choices": []}, 7), ("gpt-4o", None, None),
    ])
    assert got[0].cost_usd == pytest.approx(0.6 * 0.0025 + 0.4 * 0.00125 + 0.1 * 0.010) and got[1].cost_usd == got[0].cost_usd
    assert got[1].total_tokens == 1100 and got[1].cached_tokens == 400
    assert got[2].cost_usd == pytest.approx(0.01 * 0.00015)  # the longest overlap, not the first
    assert [got[i].cost_usd for i in (3, 4, 5)] == [0, 0, 0]
    assert (got[5].completion_tokens, got[5].requests) == (13, 1)
    assert (got[6].completion_tokens, got[6].total_tokens) == (9, 9) and got[6].cost_usd == pytest.approx(9 * 0.010 / 1000)
    assert (got[7].total_tokens, got[7].requests) == (0, 0)


def test_audit(spark, tmp_path):
    events = spark.createDataFrame([
        ("r1", "start", "RUNNING", "2024-01-01 00:00:00"), ("r1", "end", "FAILED", "2024-01-01 00:00:02.5"), ("r2", "start", "RUNNING", "2024-01-01 00:00:00"),
    ], "key string, event string, status string, t string").select("key", "event", "status", F.col("t").cast("timestamp").alias("ts"))
    path = str(tmp_path / "e")
    au.log_events(events, path)
    au.log_events(events.where("false").withColumn("extra", F.lit(1)), path)
    back = tb.read_merged(spark, path)
    assert set(StructType.fromDDL(EVENT_SCHEMA).fieldNames()) <= set(back.columns)
    state = {r.key: (r.status, r.duration_seconds) for r in au.run_state(back).collect()}
    assert state == {"r1": ("FAILED", 2.5), "r2": ("RUNNING", None)}
    assert au.latest(back, "ts", "key", 1).first().event == "end"
    days = spark.createDataFrame([("2024-01-01", True, False, None), ("2024-01-01", True, True, "pii"), ("2024-01-02", False, False, "x")],
                                 "d string, pre_blocked boolean, post_blocked boolean, reason string").withColumn("ts", F.col("d").cast("timestamp"))
    got = {str(r.day): (r.requests, r.pre_blocks, r.post_blocks, r.block_reasons) for r in au.daily_guardrail(days).collect()}
    assert got == {"2024-01-01": (2, 2, 1, {"pii": 1, "unknown": 1}), "2024-01-02": (1, 0, 0, {})}


def test_schemas_and_evolution(spark):
    assert len(AUDIT_SCHEMAS) == 5
    old = spark.createDataFrame([("a",)], "audit_id string")
    missing = tb.missing_columns(old, AUDIT_SCHEMAS["eval_results"])
    assert "scores" in [f.name for f in missing]  # map columns are seen too
    assert tb.evolve(old, AUDIT_SCHEMAS["guardrail_audit_log"]).columns == StructType.fromDDL(AUDIT_SCHEMAS["guardrail_audit_log"]).fieldNames()
