"""Request logs: latency, errors, block rates, drift, profiles, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators.scale import exact_quantiles, side_by_side

HOUR_MS, DAY_MS = 3_600_000, 86_400_000

# Drift limits and default request limits per minute.
LATENCY_ALERT, TOKEN_ALERT = 0.50, 0.25
USER_LIMIT, ENDPOINT_LIMIT = 10, 100


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a wall-clock timestamp."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1000)


def parse_payload(df: DataFrame) -> DataFrame:
    """Typed columns of an inference payload log whose request and response are JSON text."""
    asked = F.get_json_object("request", "$.messages[0].content")
    said = F.get_json_object("response", "$.messages[0].content")
    return df.select(
        "request_time", "request_date", "status_code",
        F.col("execution_duration_ms").alias("latency_ms"),
        F.col("served_entity_id").alias("model_id"),
        asked.alias("user_query"), F.length(asked).alias("query_length"),
        said.alias("assistant_response"), F.length(said).alias("response_length"),
        F.when(F.col("status_code") == 200, 0).otherwise(1).alias("is_error"),
        "requester",
    )


def op_metrics(df: DataFrame, as_of_ms: int, hours: int = 1, by: list[str] | None = None) -> DataFrame:
    """Requests, latency mean and quantiles, errors and mean tokens of the last ``hours``."""
    by = by or []
    rows = df.where(F.col("timestamp_ms") > as_of_ms - hours * HOUR_MS)
    base = rows.groupBy(*by).agg(
        F.count("*").alias("total_requests"),
        F.round(F.avg("response_duration_ms"), 2).alias("avg_latency_ms"),
        F.coalesce(F.sum(F.when(F.col("status_code") != 200, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("error_count"),
        F.round(F.avg("total_tokens_count"), 0).alias("avg_tokens_per_request"),
    )
    names = ["p50_latency_ms", "p95_latency_ms", "p99_latency_ms"]
    q = exact_quantiles(rows, by, "response_duration_ms", [0.5, 0.95, 0.99], names)
    return side_by_side([base, q.withColumns({n: F.round(n, 2) for n in names})], by)


def _blocked(kind: str, prefix: str) -> Column:
    return F.coalesce(F.element_at("tags", f"{prefix}.{kind}.blocked") == "true", F.lit(False))


def block_reasons(traces: DataFrame, as_of_ms: int, hours: int = 24, prefix: str = "guardrail") -> DataFrame:
    """Blocked requests per reason; ``unknown`` where the trace names none."""
    rows = traces.where((F.col("timestamp_ms") > as_of_ms - hours * HOUR_MS) & _blocked("pre_llm", prefix))
    reason = F.coalesce(F.element_at("tags", f"{prefix}.pre_llm.blocked_by"), F.lit("unknown"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("blocks"))


def guardrail_metrics(traces: DataFrame, as_of_ms: int, hours: int = 24, prefix: str = "guardrail") -> DataFrame:
    """One row: requests, blocks before and after the model, blocks per reason, rates (null without requests)."""
    rows = traces.where(F.col("timestamp_ms") > as_of_ms - hours * HOUR_MS)
    pre, post = _blocked("pre_llm", prefix), _blocked("post_llm", prefix)
    reason = F.when(pre, F.coalesce(F.element_at("tags", f"{prefix}.pre_llm.blocked_by"), F.lit("unknown")))
    # One row per reason first, so what is gathered into the map is as long as the list of checks.
    per_reason = rows.groupBy(reason.alias("reason")).agg(
        F.count("*").alias("n"),
        F.sum(F.when(pre, 1).otherwise(0)).alias("pre"),
        F.sum(F.when(post, 1).otherwise(0)).alias("post"),
    )
    entry = F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_reason.agg(
        total.cast("bigint").alias("total_requests"),
        F.coalesce(F.sum("pre"), F.lit(0)).cast("bigint").alias("pre_llm_blocks"),
        F.coalesce(F.sum("post"), F.lit(0)).cast("bigint").alias("post_llm_blocks"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("block_reasons"),
        F.when(total > 0, F.sum("pre") / total).alias("pre_llm_block_rate"),
        F.when(total > 0, F.sum("post") / total).alias("post_llm_block_rate"),
    )


def drift(df: DataFrame, as_of_ms: int, days: int = 7) -> DataFrame:
    """The last day against the days before it: means and relative changes, in one scan."""
    ts = F.col("timestamp_ms")
    recent = ts > as_of_ms - DAY_MS
    rows = df.where(ts > as_of_ms - days * DAY_MS)

    def means(col: str, name: str) -> list[Column]:
        return [
            F.avg(F.when(recent, F.col(col))).alias(f"recent_{name}"),
            F.avg(F.when(~recent, F.col(col))).alias(f"baseline_{name}"),
        ]

    m = rows.agg(*means("response_duration_ms", "latency"), *means("total_tokens_count", "tokens"))

    def change(name: str) -> Column:
        base = F.col(f"baseline_{name}")
        return F.abs(F.col(f"recent_{name}") - base) / F.nullif(base, F.lit(0.0))

    return m.select(
        "recent_latency", "baseline_latency", change("latency").alias("latency_drift_pct"),
        "recent_tokens", "baseline_tokens", change("tokens").alias("token_drift_pct"),
    )


def drift_alerts(d: DataFrame) -> DataFrame:
    return d.withColumns({
        "latency_alert": F.coalesce(F.col("latency_drift_pct"), F.lit(0.0)) > LATENCY_ALERT,
        "token_alert": F.coalesce(F.col("token_drift_pct"), F.lit(0.0)) > TOKEN_ALERT,
    })


def monitoring_cycle(payload: DataFrame, traces: DataFrame, as_of_ms: int, hours: int = 24, days: int = 7) -> DataFrame:
    """Operations, screening and drift in one row; each of the three is a single row."""
    screened = guardrail_metrics(traces, as_of_ms, hours).withColumnRenamed("total_requests", "traced_requests")
    return side_by_side([op_metrics(payload, as_of_ms, hours), screened, drift_alerts(drift(payload, as_of_ms, days))], [])


# ---------------------------------------------------------------- profiles

_TRUNC = {"1 hour": "hour", "1 day": "day", "1 week": "week", "1 month": "month"}


def _sliced(df: DataFrame, ts: str, granularity: str, slice_col: str | None) -> DataFrame:
    value = F.col(slice_col).cast("string") if slice_col else F.lit("all")
    return df.select("*", F.date_trunc(_TRUNC[granularity], F.col(ts)).alias("window_start"), value.alias("slice"))


def profile(df: DataFrame, ts: str, granularity: str, numeric: list[str], slice_col: str | None = None,
            quantiles: bool = True, exact_distinct: bool = True) -> DataFrame:
    """Per window, slice and numeric column: rows, nulls, min, max, mean, distinct values, quartiles."""
    rows = _sliced(df, ts, granularity, slice_col)
    long = rows.unpivot(
        ["window_start", "slice"], [F.col(c).cast("double").alias(c) for c in numeric], "column", "value"
    )
    keys = ["window_start", "slice", "column"]
    base = long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).cast("bigint").alias("nulls"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        (F.countDistinct("value") if exact_distinct else F.approx_count_distinct("value")).alias("distinct"),
    )
    if not quantiles:
        return base
    return side_by_side([base, exact_quantiles(long, keys, "value", [0.25, 0.5, 0.75])], keys)


def category_counts(df: DataFrame, ts: str, granularity: str, column: str, slice_col: str | None = None) -> DataFrame:
    """Rows per window, slice and category."""
    rows = _sliced(df, ts, granularity, slice_col)
    return rows.groupBy("window_start", "slice", F.col(column).cast("string").alias("category")).agg(F.count("*").alias("n"))


def window_drift(prof: DataFrame) -> DataFrame:
    """Change of the mean between consecutive windows of a profile (one row per window: small)."""
    w = Window.partitionBy("slice", "column").orderBy("window_start")
    prev = F.lag("mean").over(w)
    return prof.select(
        "window_start", "slice", "column", "mean", prev.alias("previous_mean"),
        (F.col("mean") - prev).alias("mean_change"),
        ((F.col("mean") - prev) / F.nullif(F.abs(prev), F.lit(0.0))).alias("relative_change"),
    )


def category_drift(counts: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Population stability index of the categories against the window before.

    Shares below ``floor`` count as ``floor``, so new and vanished categories
    stay finite.
    """
    totals = counts.groupBy("window_start", "slice").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("slice").orderBy("window_start")
    steps = totals.withColumns({
        "prev_start": F.lag("window_start").over(w), "prev_total": F.lag("total").over(w),
        "next_start": F.lead("window_start").over(w),
    })
    now = counts.join(steps, ["window_start", "slice"]).where(F.col("prev_start").isNotNull()).select(
        "window_start", "slice", "category", (F.col("n") / F.col("total")).alias("p"), F.lit(None).cast("double").alias("q")
    )
    before = counts.join(steps, ["window_start", "slice"]).where(F.col("next_start").isNotNull()).select(
        F.col("next_start").alias("window_start"), "slice", "category",
        F.lit(None).cast("double").alias("p"), (F.col("n") / F.col("total")).alias("q"),
    )
    both = now.unionByName(before).groupBy("window_start", "slice", "category").agg(F.max("p").alias("p"), F.max("q").alias("q"))
    p = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(floor))
    q = F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(floor))
    return both.groupBy("window_start", "slice").agg(F.sum((p - q) * F.ln(p / q)).alias("psi"))


# ---------------------------------------------------------------- models, traffic, limits


def model_stats(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("model_id").agg(
        F.count("*").alias("requests"), F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg("is_error").alias("error_rate"), F.avg("response_length").alias("avg_response_length"),
    )


def model_compare(parsed: DataFrame, champion: str, challenger: str) -> DataFrame:
    """One row: the challenger's figures minus the champion's."""
    stats = model_stats(parsed.where(F.col("model_id").isin(champion, challenger)))

    def of(model: str, col: str) -> Column:
        return F.max(F.when(F.col("model_id") == model, F.col(col)))

    cols = ["requests", "avg_latency_ms", "error_rate", "avg_response_length"]
    return stats.agg(
        *[of(champion, c).alias(f"champion_{c}") for c in cols],
        *[of(challenger, c).alias(f"challenger_{c}") for c in cols],
        *[(of(challenger, c) - of(champion, c)).alias(f"{c}_diff") for c in cols],
    )


def assign_traffic(df: DataFrame, key: Column, shares: dict[str, int], hashed: bool = True) -> DataFrame:
    """``served_model`` per row: the same key always gets the same model.

    ``hashed=False`` takes a whole-number key modulo 100 as it is.
    """
    if sum(shares.values()) != 100 or any(s < 0 for s in shares.values()):
        raise ValueError(f"traffic shares must be whole percentages that sum to 100: {shares}")
    bucket = F.pmod(F.xxhash64(key) if hashed else key, F.lit(100))
    upto, pick = 0, None
    for model, share in shares.items():
        upto += share
        pick = F.when(bucket < upto, model) if pick is None else pick.when(bucket < upto, model)
    return df.withColumn("served_model", pick)


def rate_limit(
    df: DataFrame, ts: str, user: str, endpoint: str, per_user: int = USER_LIMIT, per_endpoint: int = ENDPOINT_LIMIT,
    unit: str = "minute",
) -> DataFrame:
    """``scope, key, window_start, requests`` wherever a user or an endpoint went over its limit."""
    start = F.date_trunc(unit, F.col(ts)).alias("window_start")

    def over(scope: str, col: str, limit: int) -> DataFrame:
        n = df.groupBy(F.col(col).cast("string").alias("key"), start).agg(F.count("*").alias("requests"))
        return n.where(F.col("requests") > limit).select(F.lit(scope).alias("scope"), "key", "window_start", "requests")

    return over("user", user, per_user).unionByName(over("endpoint", endpoint, per_endpoint))
