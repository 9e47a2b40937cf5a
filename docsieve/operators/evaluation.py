"""Scoring of answers, aggregation of scores and release gates.

Scores travel in long form, one row per ``row_id`` and ``scorer``: every
aggregate is then one grouping, however many scorers ran.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.operators.scale import side_by_side

from docsieve.functions.text import strip
from docsieve.operators.scale import global_rank

# ---------------------------------------------------------------- fixed values

YES, NO = ["yes", "true", "pass", "passed"], ["no", "false", "fail", "failed"]
JUDGE_PATTERNS = [r"[Ss]core[:\s]+(\d)", r"(\d)\s*/\s*5", r"\b([1-5])\b"]
JUDGE_DEFAULT = 3.0
FACTS_SHARE = 0.8
GLOBAL_THRESHOLD = 3.5
TEXT_LIMIT = 4000
# Stored column -> scorer.
LEGACY_COLUMNS = {
    "toxicity_score": "toxicity",
    "accuracy_score": "accuracy",
    "helpfulness_score": "helpfulness",
    "professionalism_score": "professionalism",
    "docs_relevance_score": "docs_relevance",
    "code_snippet_score": "code_snippet_quality",
    "source_citation_score": "source_citation",
    "answer_completeness_score": "answer_completeness",
}

# ---------------------------------------------------------------- scorers

Scorer = Callable[[dict[str, Column]], Column]
SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str, build: Scorer) -> None:
    """Add a scorer: a function from the row's columns to a score column (expression or Arrow UDF)."""
    SCORERS[name] = build


def score_keyword(c: Column, mode: str, patterns: list[str]) -> Column:
    """``yes`` or ``no``; an unknown mode is ``yes``."""
    text = F.coalesce(c, F.lit(""))
    hits = [text.rlike("(?U)" + p) for p in patterns]
    every = reduce(lambda a, b: a & b, hits, F.lit(True))
    some = reduce(lambda a, b: a | b, hits, F.lit(False))
    verdict = {"must_contain_all": every, "must_contain_any": some, "must_not_contain": ~some}.get(mode, F.lit(True))
    return F.when(verdict, "yes").otherwise("no")


def score_facts(c: Column, facts: Column, min_share: float = FACTS_SHARE) -> Column:
    """``yes`` if enough expected facts occur in the text, in any case; no facts is ``yes``."""
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.size(F.filter(facts, lambda f: F.contains(low, F.lower(f))))
    n = F.size(facts)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "yes").when(found / n >= min_share, "yes").otherwise("no")


def parse_score(c: Column) -> Column:
    """The judge's mark in its text: ``Score: n``, else ``n/5``, else a lone digit 1 to 5, else 3."""
    found = [F.nullif(F.regexp_extract(c, "(?U)" + p, 1), F.lit("")).try_cast("double") for p in JUDGE_PATTERNS]
    return F.coalesce(*found, F.lit(JUDGE_DEFAULT))


def coerce_score(c: Column) -> Column:
    """A number as it is, yes-words 1, no-words 0, anything else null."""
    text = F.lower(strip(c.cast("string")))
    number = F.when(text.rlike("^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[-+]?[0-9]+)?$"), text.try_cast("double"))
    return F.coalesce(number, F.when(text.isin(YES), 1.0).when(text.isin(NO), 0.0))


def score_rows(df: DataFrame, row_id: str, scorers: dict[str, Column]) -> DataFrame:
    """``row_id, scorer, value`` for several scorers in one scan."""
    wide = df.select(F.col(row_id).alias("row_id"), *[c.cast("string").alias(n) for n, c in scorers.items()])
    return wide.unpivot("row_id", list(scorers), "scorer", "value")


# ---------------------------------------------------------------- collecting scores


def scores_long(df: DataFrame, row_id: str, assessments: str | None = None) -> DataFrame:
    """``row_id, scorer, score`` from ``<scorer>/value`` and ``<scorer>/v1/score`` columns and an assessment array.

    Columns win over assessments, the earlier one wins among equals, and
    values that are no score are skipped.
    """
    entries = []
    for c in df.columns:
        for suffix in ("/value", "/v1/score"):
            if c.endswith(suffix):
                name = c[: -len(suffix)]
                entries.append(F.struct(F.lit(name).alias("scorer"), coerce_score(F.col(f"`{c}`")).alias("score")))
    listed = F.array(*entries) if entries else F.array().cast("array<struct<scorer:string,score:double>>")
    if assessments:
        given = F.coalesce(F.col(assessments), F.array().cast(df.schema[assessments].dataType))
        listed = F.concat(listed, F.transform(given, lambda a: F.struct(
            a["assessment_name"].alias("scorer"), coerce_score(a["feedback"]["value"]).alias("score"))))
    usable = F.filter(listed, lambda e: e["scorer"].isNotNull() & (e["scorer"] != "") & e["score"].isNotNull())
    # The list of one row is in priority order: drop an entry whose scorer came before.
    names = F.transform(usable, lambda e: e["scorer"])
    first = F.filter(usable, lambda e, i: F.array_position(names, e["scorer"]) == i + 1)
    return df.select(F.col(row_id).alias("row_id"), F.explode(first).alias("e")).select("row_id", "e.scorer", "e.score")


def scores_map(long: DataFrame) -> DataFrame:
    """``row_id, scores`` with one map per row."""
    entries = F.array_sort(F.collect_list(F.struct("scorer", "score")))
    return long.groupBy("row_id").agg(F.map_from_entries(entries).alias("scores"))


def legacy_scores(mapped: DataFrame) -> DataFrame:
    """The fixed columns of the stored results; a scorer that did not run is 0."""
    return mapped.select("*", *[
        F.coalesce(F.element_at("scores", scorer), F.lit(0.0)).alias(col) for col, scorer in LEGACY_COLUMNS.items()
    ])


def merge_groups(groups: list[DataFrame], row_id: str = "row_id") -> DataFrame:
    """Results of scorer groups side by side, each column from the first group that has it; a group has one row a row id.

    One union and one grouping, however many groups there are; null ids meet.
    """
    seen, parts = {row_id}, []
    for g in groups:
        new = [c for c in g.columns if c not in seen]
        if new or not parts:
            parts.append(g.select(row_id, *new))
        seen.update(new)
    return side_by_side(parts, [row_id])


# ---------------------------------------------------------------- aggregates and gates


def scorer_means(long: DataFrame) -> DataFrame:
    """``metric, mean, pass_rate, n`` per scorer; the pass rate counts scores of at least 1."""
    return long.groupBy("scorer").agg(
        F.avg("score").alias("mean"),
        F.avg(F.when(F.col("score") >= 1, 1.0).when(F.col("score").isNotNull(), 0.0)).alias("pass_rate"),
        F.count("score").alias("n"),
    ).select(F.concat("scorer", F.lit("/mean")).alias("metric"), "scorer", "mean", "pass_rate", "n")


def thresholds(config: DataFrame, overall: float = GLOBAL_THRESHOLD) -> DataFrame:
    """``metric, threshold, in_scale`` of the enabled scorers.

    ``config`` holds ``name, type, enabled, threshold``. Judges and rubrics
    are held to their mean, everything else to its pass rate; ``in_scale``
    tells when a threshold lies outside what the metric can reach.
    """
    graded = F.col("type").isin("llm_judge", "rubric")
    own = F.coalesce("threshold", F.lit(overall))
    return config.where(F.coalesce("enabled", F.lit(True))).select(
        F.concat("name", F.when(graded, "/mean").otherwise("/average")).alias("metric"),
        own.alias("threshold"), (own <= F.when(graded, 5.0).otherwise(1.0)).alias("in_scale"),
    )


def quality_gate(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """``metric, threshold, actual, status`` with status passed, failed or missing."""
    joined = limits.join(metrics.select("metric", F.col("actual")), "metric", "left")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") >= F.col("threshold"), "passed").otherwise("failed")
    return joined.select("metric", "threshold", "actual", status.alias("status"))


def gate_verdict(gate: DataFrame, strict: bool = False) -> DataFrame:
    """One row. Missing metrics are passed over unless ``strict``."""
    ok = F.col("status") == "passed"
    ok = ok if strict else ok | (F.col("status") == "missing")
    return gate.agg(
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("passed"),
        F.sum(F.when(F.col("status") == "missing", 1).otherwise(0)).cast("bigint").alias("missing"),
    )


def weighted_score(means: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: the weighted mean over scorers; a scorer without a weight counts once."""
    joined = means.join(weights.select("scorer", "weight"), "scorer", "left")
    w = F.coalesce("weight", F.lit(1.0))
    return joined.agg((F.sum(F.when(F.col("mean").isNotNull(), w * F.col("mean"))) / F.sum(F.when(F.col("mean").isNotNull(), w))).alias("weighted_score"))


def score_distribution(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = by or ["scorer"]
    return long.where(F.col("score").isNotNull()).groupBy(*keys).agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"),
        F.max("score").alias("max"), F.count("*").alias("n"),
    )


def pick_winner(results: DataFrame) -> DataFrame:
    """One row: the configuration with the highest score above -1; the first one on ties.

    ``results`` holds ``config, position, score``.
    """
    key = F.struct("score", -F.col("position"))
    return results.where(F.col("score") > -1).agg(
        F.max_by("config", key).alias("winner"), F.max("score").alias("winner_score")
    )


def objective(long: DataFrame, rows: DataFrame) -> DataFrame:
    """Mean of all coerced scores per row of ``rows``; 0 where nothing scored it. ``long`` holds ``row_id, value``."""
    mean = long.groupBy("row_id").agg(F.avg(coerce_score(F.col("value"))).alias("_m"))
    return rows.select("row_id").join(mean, "row_id", "left").select("row_id", F.coalesce("_m", F.lit(0.0)).alias("objective"))


def improvement(df: DataFrame) -> DataFrame:
    """Add ``improvement`` and ``promoted``: only a strictly better score is promoted."""
    delta = F.col("final_score") - F.col("initial_score")
    return df.withColumns({"improvement": delta, "promoted": F.coalesce(delta > 0, F.lit(False))})


# ---------------------------------------------------------------- stored results


def result_rows(scored: DataFrame, meta: dict[str, str], passed: bool, as_of: Column) -> DataFrame:
    """Rows for the results table: texts cut to length, run data and the run's verdict added.

    ``scored`` holds ``row_index, request, response, expected_response, scores``.
    """
    cut = {c: F.left(F.coalesce(c, F.lit("")), F.lit(TEXT_LIMIT)) for c in ("request", "response", "expected_response")}
    return legacy_scores(scored.withColumns(cut)).withColumns({
        **{k: F.lit(v) for k, v in meta.items()}, "overall_passed": F.lit(passed), "evaluated_at": as_of,
    })


def preview(results: DataFrame, evaluation_id: str, cols: list[str], digits: int = 2) -> DataFrame:
    """The rows of one evaluation in row order, scores rounded."""
    return results.where(F.col("evaluation_id") == evaluation_id).select(
        "row_index", "request", *[F.round(c, digits).alias(c) for c in cols]
    ).orderBy("row_index")


# ---------------------------------------------------------------- traces and datasets


def human_feedback(traces: DataFrame) -> DataFrame:
    """Traces that a person assessed, other than by writing the expected response."""
    return traces.where(F.exists("assessments", lambda a: (a["source"]["source_type"] == "HUMAN")
                                 & (a["assessment_name"] != "expected_response")))


def assessment_counts(traces: DataFrame) -> DataFrame:
    each = traces.select(F.explode("assessments").alias("a"))
    return each.groupBy(F.col("a.assessment_name").alias("name"), F.col("a.source.source_type").alias("source")).agg(
        F.count("*").alias("n")
    )


def split_train_val(df: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """Add ``split``: the first ``share`` of the rows in key order is ``train``, the rest ``validation``."""
    ranked = global_rank(df, [key])
    cut = F.floor(F.col("_total") * F.lit(share))
    return ranked.withColumn("split", F.when(F.col("_rank") < cut, "train").otherwise("validation")).drop("_rank", "_total")


def eval_rows(df: DataFrame, request: str, expected: str, facts: str | None = None) -> DataFrame:
    """Evaluation rows ``inputs<query>, expectations<expected_response, expected_facts>``."""
    listed = F.col(facts) if facts else F.lit(None).cast("array<string>")
    return df.withColumns({
        "inputs": F.struct(F.col(request).alias("query")),
        "expectations": F.struct(F.col(expected).alias("expected_response"), listed.alias("expected_facts")),
    })
