import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsieve.operators import evaluation as ev
from docsieve.schemas import AUDIT_SCHEMAS
from docsieve.sources import tables as tb


def col(spark, build, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_keyword(spark):
    texts = ["alpha 12", "alpha", "beta", None]
    pats = ["alpha", r"\d+"]
    assert col(spark, lambda c: ev.score_keyword(c, "must_contain_all", pats), texts) == ["yes", "no", "no", "no"]
    assert col(spark, lambda c: ev.score_keyword(c, "must_contain_any", pats), texts) == ["yes", "yes", "no", "no"]
    assert col(spark, lambda c: ev.score_keyword(c, "must_not_contain", pats), texts) == ["no", "no", "yes", "yes"]
    assert col(spark, lambda c: ev.score_keyword(c, "other", pats), texts) == ["yes"] * 4


def test_facts(spark):
    rows = [("Delta is ACID", ["delta", "acid"]), ("Delta", ["delta", "acid"]), ("x", []), ("x", None), (None, ["a"]),
            ("a b c d", ["A", "b", "c", "d", "zz"])]
    df = spark.createDataFrame(rows, "t string, f array<string>")
    assert [r.y for r in df.select(ev.score_facts(F.col("t"), F.col("f")).alias("y")).collect()] == ["yes", "no", "yes", "yes", "no", "yes"]


def test_parse_and_coerce(spark):
    assert col(spark, ev.parse_score, ["Score: 4", "score 2", "I say 3 / 5", "give it 2", "12 or 55", "", None]) == [4, 2, 3, 2, 3, 3, 3]
    assert col(spark, ev.coerce_score, ["3.5", "yes", " TRUE ", "Passed", "no", "fail", "maybe", "", None, "1e1", "-2"]) == \
        [3.5, 1, 1, 1, 0, 0, None, None, None, 10, -2]


def test_scores_long(spark):
    schema = "row_id int, `x/value` string, `y/v1/score` double, `x/v1/score` double, a array<struct<assessment_name:string,feedback:struct<value:string>>>"
    rows = [(1, "yes", 2.0, 9.0, [("x", ("0.1",)), ("z", ("no",)), ("z", ("yes",)), (None, ("1",))]), (2, None, None, 5.0, None), (3, "junk", None, None, [("x", ("4",))])]
    df = spark.createDataFrame(rows, schema)
    got = {(r.row_id, r.scorer): r.score for r in ev.scores_long(df, "row_id", "a").collect()}
    assert got == {(1, "x"): 1.0, (1, "y"): 2.0, (1, "z"): 0.0, (2, "x"): 5.0, (3, "x"): 4.0}


def test_gate(spark):
    cfg = spark.createDataFrame([("a", "llm_judge", True, None), ("b", "rubric", True, 0.0), ("c", "keyword", None, 0.9), ("d", "llm_judge", False, 1.0),
                                 ("e", "guidelines", True, 3.5)], "name string, type string, enabled boolean, threshold double")
    lim = {r.metric: (r.threshold, r.in_scale) for r in ev.thresholds(cfg).collect()}
    assert lim == {"a/mean": (3.5, True), "b/mean": (0.0, True), "c/average": (0.9, True), "e/average": (3.5, False)}
    metrics = spark.createDataFrame([("a/mean", 3.5), ("b/mean", -1.0)], "metric string, actual double")
    gate = ev.quality_gate(metrics, ev.thresholds(cfg))
    assert {r.metric: r.status for r in gate.collect()} == {"a/mean": "passed", "b/mean": "failed", "c/average": "missing", "e/average": "missing"}
    assert not ev.gate_verdict(gate).first().passed
    rest = gate.where("metric <> 'b/mean'")
    assert ev.gate_verdict(rest).first().passed and not ev.gate_verdict(rest, strict=True).first().passed
    assert ev.gate_verdict(gate.where("false")).first().passed


def test_aggregates(spark):
    long = spark.createDataFrame([(1, "a", 4.0), (2, "a", 2.0), (1, "b", 1.0), (2, "b", 0.0)], "row_id int, scorer string, score double")
    means = ev.scorer_means(long)
    assert {r.metric: (r.mean, r.pass_rate) for r in means.collect()} == {"a/mean": (3.0, 1.0), "b/mean": (0.5, 0.5)}
    weights = spark.createDataFrame([("a", 3.0)], "scorer string, weight double")
    assert ev.weighted_score(means, weights).first()[0] == pytest.approx((9 + 0.5) / 4)
    dist = {r.scorer: (r.std, r.n) for r in ev.score_distribution(long).collect()}
    assert dist == {"a": (1.0, 2), "b": (0.5, 2)}
    results = spark.createDataFrame([("x", 1, 0.5), ("y", 2, 0.7), ("z", 3, 0.7), ("w", 0, -1.0)], "config string, position int, score double")
    assert tuple(ev.pick_winner(results).first()) == ("y", 0.7)
    assert ev.pick_winner(results.where("config = 'w'")).first().winner is None
    rows = spark.createDataFrame([(1,), (2,)], "row_id int")
    mixed = spark.createDataFrame([(1, "4"), (1, "yes"), (1, "junk")], "row_id int, value string")
    assert {r.row_id: r.objective for r in ev.objective(mixed, rows).collect()} == {1: 2.5, 2: 0.0}
    prompts = spark.createDataFrame([(1.0, 1.0), (1.0, 1.5), (2.0, 1.0), (1.0, None)], "initial_score double, final_score double")
    assert [r.promoted for r in ev.improvement(prompts).collect()] == [False, True, False, False]


def test_merge_groups_and_results(spark):
    a = spark.createDataFrame([(1, "r", 1.0)], "row_id int, request string, s1 double")
    b = spark.createDataFrame([(1, "other", 2.0), (2, "q", 3.0)], "row_id int, request string, s2 double")
    assert sorted((r.row_id, r.request, r.s1, r.s2) for r in ev.merge_groups([a, b]).collect()) == [(1, "r", 1.0, 2.0), (2, None, None, 3.0)]
    scored = spark.createDataFrame([(0, "q" * 5000, None, "e", {"accuracy": 4.0})],
                                   "row_index long, request string, response string, expected_response string, scores map<string,double>")
    out = tb.evolve(ev.result_rows(scored, {"evaluation_id": "e1"}, True, F.lit("2024-01-01").cast("timestamp")), AUDIT_SCHEMAS["eval_results"])
    r = out.first()
    assert len(r.request) == 4000 and r.response == "" and r.accuracy_score == 4.0 and r.toxicity_score == 0.0 and r.overall_passed
    assert out.columns == StructType.fromDDL(AUDIT_SCHEMAS["eval_results"]).fieldNames()
    assert ev.preview(out, "e2", ["accuracy_score"]).count() == 0


def test_feedback_and_split(spark):
    schema = "trace_id int, assessments array<struct<assessment_name:string,source:struct<source_type:string>>>"
    t = spark.createDataFrame([(1, [("ok", ("HUMAN",))]), (2, [("expected_response", ("HUMAN",)), ("ok", ("CODE",))]), (3, [])], schema)
    assert [r.trace_id for r in ev.human_feedback(t).collect()] == [1]
    assert {(r.name, r.source): r.n for r in ev.assessment_counts(t).collect()} == {("ok", "HUMAN"): 1, ("ok", "CODE"): 1, ("expected_response", "HUMAN"): 1}
    split = {r.id: r.split for r in ev.split_train_val(spark.range(10), "id").collect()}
    assert [i for i, s in split.items() if s == "train"] and sum(s == "train" for s in split.values()) == 7
    assert all(split[i] == "train" for i in range(7))


def test_register_scorer(spark):
    ev.register_scorer("long", lambda cols: F.length(cols["t"]) > 2)
    df = spark.createDataFrame([(1, "abc"), (2, "a")], "row_id int, t string")
    scored = ev.score_rows(df, "row_id", {n: build({"t": F.col("t")}) for n, build in ev.SCORERS.items()})
    assert {r.row_id: ev_val for r in scored.collect() for ev_val in [r.value]} == {1: "true", 2: "false"}
