"""Evaluation queries: documents and labels play answers and their marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.operators import evaluation as ev
from docsieve.plans.registry import query, table, text_table
from docsieve.schemas import AUDIT_SCHEMAS
from docsieve.session import scratch_path
from docsieve.sources import tables as tb

_RX = [r"\bthe\b", r"[0-9]{3}", r"ion"]


@query("a51_score_keyword", """
  SELECT doc_id, CASE WHEN a AND b AND c THEN 'yes' ELSE 'no' END AS every, CASE WHEN a OR b OR c THEN 'yes' ELSE 'no' END AS some,
    CASE WHEN a OR b OR c THEN 'no' ELSE 'yes' END AS none
  FROM (SELECT doc_id, regexp_matches(text, '(?:^|[^\\p{L}\\p{N}_])the(?:$|[^\\p{L}\\p{N}_])') AS a, regexp_matches(text, '[0-9]{3}') AS b, contains(text, 'ion') AS c FROM documents)""")
def a51(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", ev.score_keyword(c, "must_contain_all", _RX).alias("every"),
        ev.score_keyword(c, "must_contain_any", _RX).alias("some"), ev.score_keyword(c, "must_not_contain", _RX).alias("none"),
    )


@query("a52_score_facts", """
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'yes' WHEN (contains(lower(text), 'the') :: INT + contains(lower(text), 'ion') :: INT + contains(lower(text), lang) :: INT) / 3 >= 0.6 THEN 'yes' ELSE 'no' END AS verdict
  FROM documents""")
def a52(spark, sf):
    facts = F.when(F.col("doc_id") % 5 != 0, F.array(F.lit("THE"), F.lit("ion"), F.col("lang")))
    return table(spark, sf, "documents").select("doc_id", ev.score_facts(F.col("text"), facts, 0.6).alias("verdict"))


# Judge texts in four forms, made from the events' numbers.
_JUDGED_SQL = """
  SELECT event_id, user_id, event_type, value, CASE event_id % 5 WHEN 0 THEN 'Score: ' || m WHEN 1 THEN 'I say ' || m || ' / 5, event ' || event_id
    WHEN 2 THEN 'it gets ' || m || ' from me' WHEN 3 THEN event_type WHEN 4 THEN 'yes' END AS judged
  FROM (SELECT *, CAST(floor(value) AS BIGINT) % 5 + 1 AS m FROM events)"""
_PARSED_SQL = """coalesce(TRY_CAST(nullif(regexp_extract(judged, '[Ss]core[:\\s]+(\\d)', 1), '') AS DOUBLE),
    TRY_CAST(nullif(regexp_extract(judged, '(\\d)\\s*/\\s*5', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(judged, '\\b([1-5])\\b', 1), '') AS DOUBLE), 3.0)"""


def _judged(spark, sf):
    m = (F.floor("value") % 5 + 1).cast("string")
    k = F.col("event_id") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("Score: "), m))
        .when(k == 1, F.concat(F.lit("I say "), m, F.lit(" / 5, event "), F.col("event_id").cast("string")))
        .when(k == 2, F.concat(F.lit("it gets "), m, F.lit(" from me"))).when(k == 3, F.col("event_type")).otherwise("yes")
    )
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", text.alias("judged"))


@query("a53_parse_score", f"SELECT event_id, {_PARSED_SQL} AS score FROM ({_JUDGED_SQL})")
def a53(spark, sf):
    return _judged(spark, sf).select("event_id", ev.parse_score(F.col("judged")).alias("score"))


_VALUE_SQL = "CASE event_id % 6 WHEN 0 THEN CAST(floor(value) AS BIGINT) || '' WHEN 1 THEN ' Yes ' WHEN 2 THEN 'FAILED' WHEN 3 THEN event_type WHEN 4 THEN 'true' END"
_COERCED_SQL = "CASE event_id % 6 WHEN 0 THEN floor(value) WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 4 THEN 1.0 END"


def _values(spark, sf):
    k = F.col("event_id") % 6
    raw = (
        F.when(k == 0, F.floor("value").cast("string")).when(k == 1, " Yes ").when(k == 2, "FAILED")
        .when(k == 3, F.col("event_type")).when(k == 4, "true")
    )
    return text_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", raw.alias("raw"))


@query("a54_coerce_score", f"SELECT event_id, CAST({_COERCED_SQL} AS DOUBLE) AS score FROM events")
def a54(spark, sf):
    return _values(spark, sf).select("event_id", ev.coerce_score(F.col("raw")).alias("score"))


def _wide(spark, sf):
    """Score columns of two naming styles beside an assessment array."""
    v = _values(spark, sf)
    feedback = lambda name, val: F.struct(F.lit(name).alias("assessment_name"), F.struct(val.cast("string").alias("value")).alias("feedback"))
    return v.select(
        F.col("event_id").alias("row_id"), F.col("raw").alias("accuracy/value"),
        F.when(F.col("event_id") % 2 == 0, F.lit("4")).alias("toxicity/v1/score"),
        F.array(feedback("accuracy", F.lit("0.5")), feedback("helpfulness", F.col("event_id") % 5), feedback("toxicity", F.lit("no"))).alias("assessments"),
    )


_LONG_SQL = f"""
  SELECT event_id AS row_id, 'accuracy' AS scorer, CAST(coalesce({_COERCED_SQL}, 0.5) AS DOUBLE) AS score FROM events
  UNION ALL SELECT event_id, 'toxicity', CASE WHEN event_id % 2 = 0 THEN 4.0 ELSE 0.0 END FROM events
  UNION ALL SELECT event_id, 'helpfulness', CAST(event_id % 5 AS DOUBLE) FROM events"""


def _long(spark, sf):
    return ev.scores_long(_wide(spark, sf), "row_id", "assessments")


@query("a55_scores_long", _LONG_SQL)
def a55(spark, sf):
    return _long(spark, sf)


@query("a56_legacy_scores", f"""
  SELECT row_id, max(score) FILTER (scorer = 'accuracy') AS accuracy_score, max(score) FILTER (scorer = 'toxicity') AS toxicity_score,
    max(score) FILTER (scorer = 'helpfulness') AS helpfulness_score, CAST(0 AS DOUBLE) AS docs_relevance_score FROM ({_LONG_SQL}) GROUP BY row_id""")
def a56(spark, sf):
    out = ev.legacy_scores(ev.scores_map(_long(spark, sf)))
    return out.select("row_id", "accuracy_score", "toxicity_score", "helpfulness_score", "docs_relevance_score")


@query("a57_merge_groups", """
  SELECT coalesce(d.doc_id, l.doc_id) AS row_id, CAST(n_chars AS BIGINT) AS length_score, quality, toxic
  FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id""")
def a57(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("n_chars").alias("length_score"))
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id")
    return ev.merge_groups([a, labels.select("row_id", "quality"), labels.select("row_id", "quality", "toxic")])


_MEANS_SQL = f"SELECT scorer || '/mean' AS metric, scorer, avg(score) AS mean, avg(CASE WHEN score >= 1 THEN 1.0 ELSE 0.0 END) AS pass_rate, count(*) AS n FROM ({_LONG_SQL}) GROUP BY scorer"


@query("a58_scorer_means", f"SELECT metric, round(mean, 6) AS mean, round(pass_rate, 6) AS pass_rate, n FROM ({_MEANS_SQL})")
def a58(spark, sf):
    return ev.scorer_means(_long(spark, sf)).select("metric", F.round("mean", 6).alias("mean"), F.round("pass_rate", 6).alias("pass_rate"), "n")


# A scorer per part: type by brand number, some disabled, some without a threshold of their own.
_CONFIG_SQL = """
  SELECT 'scorer' || p_partkey AS name, CASE p_size % 3 WHEN 0 THEN 'rubric' WHEN 1 THEN 'keyword' ELSE 'llm_judge' END AS type,
    p_size % 7 <> 0 AS enabled, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size % 5 AS DOUBLE) END AS threshold FROM part"""
_THRESH_SQL = f"""
  SELECT name || CASE WHEN type IN ('llm_judge', 'rubric') THEN '/mean' ELSE '/average' END AS metric, coalesce(threshold, 3.5) AS threshold,
    coalesce(threshold, 3.5) <= CASE WHEN type IN ('llm_judge', 'rubric') THEN 5 ELSE 1 END AS in_scale FROM ({_CONFIG_SQL}) WHERE enabled"""


def _config(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select(
        F.concat(F.lit("scorer"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(s % 3 == 0, "rubric").when(s % 3 == 1, "keyword").otherwise("llm_judge").alias("type"),
        (s % 7 != 0).alias("enabled"), F.when(s % 4 != 0, (s % 5).cast("double")).alias("threshold"),
    )


@query("a59_thresholds", _THRESH_SQL)
def a59(spark, sf):
    return ev.thresholds(_config(spark, sf))


_ACTUAL_SQL = "SELECT 'scorer' || l_partkey || '/mean' AS metric, round(avg(l_quantity) / 10, 6) AS actual FROM lineitem GROUP BY l_partkey"
_GATE_SQL = f"""
  SELECT t.metric, threshold, actual, CASE WHEN actual IS NULL THEN 'missing' WHEN actual >= threshold THEN 'passed' ELSE 'failed' END AS status
  FROM ({_THRESH_SQL}) t LEFT JOIN ({_ACTUAL_SQL}) a ON a.metric = t.metric"""


def _gate(spark, sf):
    actual = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.round(F.avg("l_quantity") / 10, 6).alias("actual")
    ).select(F.concat(F.lit("scorer"), F.col("l_partkey").cast("string"), F.lit("/mean")).alias("metric"), "actual")
    return ev.quality_gate(actual, ev.thresholds(_config(spark, sf)))


@query("a60_quality_gate", _GATE_SQL)
def a60(spark, sf):
    return _gate(spark, sf)


@query("a60_gate_verdict", f"SELECT bool_and(status <> 'failed') AS passed, CAST(count_if(status = 'missing') AS BIGINT) AS missing FROM ({_GATE_SQL})")
def a60_verdict(spark, sf):
    return ev.gate_verdict(_gate(spark, sf))


@query("a61_weighted_score", f"SELECT round(sum(mean * CASE scorer WHEN 'accuracy' THEN 2.0 WHEN 'toxicity' THEN 0.5 ELSE 1.0 END) / sum(CASE scorer WHEN 'accuracy' THEN 2.0 WHEN 'toxicity' THEN 0.5 ELSE 1.0 END), 6) AS weighted_score FROM ({_MEANS_SQL})")
def a61(spark, sf):
    weights = spark.createDataFrame([("accuracy", 2.0), ("toxicity", 0.5)], "scorer string, weight double")
    out = ev.weighted_score(ev.scorer_means(_long(spark, sf)), weights)
    return out.select(F.round("weighted_score", 6).alias("weighted_score"))


@query("a62_score_distribution", f"SELECT scorer, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, min(score) AS min, max(score) AS max, count(*) AS n FROM ({_LONG_SQL}) GROUP BY scorer")
def a62(spark, sf):
    out = ev.score_distribution(_long(spark, sf))
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


_RESULTS_SQL = "SELECT event_type AS config, min(event_id) AS position, round(avg(value), 4) AS score FROM events GROUP BY event_type"


@query("a63_pick_winner", f"SELECT config AS winner, score AS winner_score FROM ({_RESULTS_SQL}) ORDER BY score DESC, position LIMIT 1")
def a63(spark, sf):
    results = table(spark, sf, "events").groupBy(F.col("event_type").alias("config")).agg(
        F.min("event_id").alias("position"), F.round(F.avg("value"), 4).alias("score")
    )
    return ev.pick_winner(results)


@query("a64_objective", f"SELECT user_id AS row_id, round(coalesce(avg({_COERCED_SQL}), 0), 6) AS objective FROM events GROUP BY user_id")
def a64(spark, sf):
    v = _values(spark, sf)
    out = ev.objective(v.select(F.col("user_id").alias("row_id"), F.col("raw").alias("value")), v.select(F.col("user_id").alias("row_id")).distinct())
    return out.withColumn("objective", F.round("objective", 6))


@query("a65_improvement", """
  SELECT user_id, round(f - i, 6) AS improvement, coalesce(f - i > 0, false) AS promoted FROM (
    SELECT user_id, round(avg(value) FILTER (ts < TIMESTAMP '2024-01-16'), 6) AS i, round(avg(value) FILTER (ts >= TIMESTAMP '2024-01-16'), 6) AS f FROM events GROUP BY user_id)""")
def a65(spark, sf):
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    runs = table(spark, sf, "events").groupBy("user_id").agg(
        F.round(F.avg(F.when(~late, F.col("value"))), 6).alias("initial_score"), F.round(F.avg(F.when(late, F.col("value"))), 6).alias("final_score")
    )
    return ev.improvement(runs).select("user_id", F.round("improvement", 6).alias("improvement"), "promoted")


def _results(spark, sf):
    """Documents as answered questions, their labels as scores."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("row_index"), F.col("source").alias("request"), F.col("text").alias("response"), F.col("lang").alias("expected_response"),
        F.map_from_arrays(F.array(F.lit("accuracy"), F.lit("toxicity")), F.array(F.col("quality") * 4.567, F.col("toxic").cast("double"))).alias("scores"),
    )
    meta = {"evaluation_id": "ev-1", "execution_id": "run-1", "context": "", "agent_name": "docs", "agent_version": "1", "environment": "dev"}
    return ev.result_rows(scored, meta, True, F.lit("2024-02-01").cast("timestamp_ntz"))


@query("a66_save_results", """
  SELECT d.doc_id AS row_index, 'ev-1' AS evaluation_id, md5(left(text, 4000)) AS response, coalesce(round(quality * CAST(4.567 AS DOUBLE), 6), 0) AS accuracy_score,
    CAST(coalesce(toxic, 0) AS DOUBLE) AS toxicity_score, true AS overall_passed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def a66(spark, sf):
    # Appended to the results table and read back by its declared columns.
    path = scratch_path(spark, "results")
    tb.save_append(tb.evolve(_results(spark, sf), AUDIT_SCHEMAS["eval_results"]), path)
    out = spark.read.schema(AUDIT_SCHEMAS["eval_results"]).parquet(path)
    return out.select("row_index", "evaluation_id", F.md5("response").alias("response"), F.round("accuracy_score", 6).alias("accuracy_score"), "toxicity_score", "overall_passed")


@query("a67_preview", """
  SELECT d.doc_id AS row_index, source AS request, coalesce(round(quality * CAST(4.567 AS DOUBLE), 2), 0) AS accuracy_score, round(CAST(coalesce(toxic, 0) AS DOUBLE), 2) AS toxicity_score
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def a67(spark, sf):
    return ev.preview(_results(spark, sf), "ev-1", ["accuracy_score", "toxicity_score"])


# A trace per event; who assessed it and how depends on the event.
_TRACE_SQL = """
  SELECT event_id AS trace_id, CASE user_id % 3 WHEN 0 THEN 'HUMAN' WHEN 1 THEN 'LLM_JUDGE' ELSE 'CODE' END AS s1, CASE WHEN event_id % 4 = 0 THEN 'expected_response' ELSE event_type END AS n1,
    CASE WHEN event_id % 7 = 0 THEN 'HUMAN' ELSE 'CODE' END AS s2, 'latency' AS n2, CASE event_id % 2 WHEN 0 THEN 'no' ELSE 'yes' END AS v1 FROM events"""


def traces(spark, sf):
    e = table(spark, sf, "events")
    one = lambda name, source, val: F.struct(
        name.alias("assessment_name"), F.struct(source.alias("source_type"), F.lit("x").alias("source_id")).alias("source"),
        F.struct(val.alias("value")).alias("feedback"))
    s1 = F.when(F.col("user_id") % 3 == 0, "HUMAN").when(F.col("user_id") % 3 == 1, "LLM_JUDGE").otherwise("CODE")
    n1 = F.when(F.col("event_id") % 4 == 0, "expected_response").otherwise(F.col("event_type"))
    s2 = F.when(F.col("event_id") % 7 == 0, "HUMAN").otherwise("CODE")
    v1 = F.when(F.col("event_id") % 2 == 0, "no").otherwise("yes")
    return e.select(F.col("event_id").alias("trace_id"), "user_id", "ts", F.array(one(n1, s1, v1), one(F.lit("latency"), s2, F.floor("value").cast("string"))).alias("assessments"))


@query("a68_human_feedback", f"SELECT trace_id FROM ({_TRACE_SQL}) WHERE (s1 = 'HUMAN' AND n1 <> 'expected_response') OR s2 = 'HUMAN'")
def a68(spark, sf):
    return ev.human_feedback(traces(spark, sf)).select("trace_id")


@query("a69_assessment_counts", f"SELECT name, source, count(*) AS n FROM (SELECT n1 AS name, s1 AS source FROM ({_TRACE_SQL}) UNION ALL SELECT n2, s2 FROM ({_TRACE_SQL})) GROUP BY 1, 2")
def a69(spark, sf):
    return ev.assessment_counts(traces(spark, sf))


@query("a70_split_train_val", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(0.7 * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split FROM documents")
def a70(spark, sf):
    return ev.split_train_val(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("a71_eval_rows", "SELECT doc_id, md5(text) AS query, lang AS expected_response, CAST(2 AS INTEGER) AS facts FROM documents")
def a71(spark, sf):
    d = table(spark, sf, "documents").withColumn("facts", F.array("lang", "source"))
    return ev.eval_rows(d, "text", "lang", "facts").select(
        "doc_id", F.md5("inputs.query").alias("query"), "expectations.expected_response", F.size("expectations.expected_facts").alias("facts")
    )
