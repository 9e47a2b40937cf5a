"""Token usage and its cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.prices import PRICES

_USAGE = (
    "struct<usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,cached_tokens:bigint,"
    "prompt_tokens_details:struct<cached_tokens:bigint>>>"
)
CHUNK_TOKENS = 1.3  # fixed value: tokens assumed per streamed chunk without usage figures


def token_usage(df: DataFrame, response: str, chunks: str | None = None) -> DataFrame:
    """Token counts from the response JSON; an estimate from the chunk count if a stream reports none."""
    u = F.col("_u")["usage"]
    zero = F.lit(0).cast("bigint")
    streamed = F.coalesce(F.col(chunks), F.lit(0)) if chunks else F.lit(0)
    estimate = F.when(streamed > 0, F.floor(streamed * F.lit(CHUNK_TOKENS))).otherwise(zero)
    known = u.isNotNull()
    prompt = F.coalesce(u["prompt_tokens"], zero)
    completion = F.when(known, F.coalesce(u["completion_tokens"], zero)).otherwise(estimate)
    out = df.withColumn("_u", F.from_json(F.col(response), _USAGE)).withColumns({
        "prompt_tokens": prompt,
        "completion_tokens": completion,
        "cached_tokens": F.coalesce(u["cached_tokens"], u["prompt_tokens_details"]["cached_tokens"], zero),
        "total_tokens": F.coalesce(F.nullif(u["total_tokens"], F.lit(0)), prompt + completion),
        "requests": F.when(known | (streamed > 0), 1).otherwise(0),
    })
    return out.drop("_u")


def price_of(model: Column, prices: dict[str, tuple[float, float, float]] | None = None) -> Column:
    """``(input, output, cached)`` per 1,000 tokens: exact name, else the longest overlap, else null.

    The price list is configuration and becomes part of the expression, so no
    join and no shuffle is needed.
    """
    listed = PRICES if prices is None else prices
    name = F.lower(F.coalesce(model, F.lit("")))

    def rate(p: tuple[float, float, float]) -> Column:
        return F.struct(F.lit(p[0]).alias("input"), F.lit(p[1]).alias("output"), F.lit(p[2]).alias("cached"))

    exact = F.create_map(*[c for n, p in listed.items() for c in (F.lit(n), rate(p))])
    rows = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(i).alias("i"), rate(p).alias("rate")) for i, (n, p) in enumerate(listed.items())
    ])
    near = F.filter(rows, lambda r: F.contains(name, r["name"]) | F.contains(r["name"], name))
    # Longest overlap first, then list order: the smallest (-overlap, i).
    ranked = F.transform(near, lambda r: F.struct(
        (-F.least(F.length(name), F.length(r["name"]))).alias("o"), r["i"].alias("i"), r["rate"].alias("rate")
    ))
    return F.when(name != "", F.coalesce(F.element_at(exact, name), F.array_min(ranked)["rate"]))


def token_cost(usage: DataFrame, model: str, prices: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """Add ``cost_usd``: cached tokens at the reduced rate, the rest at the input rate; unknown models cost 0."""
    p = F.col("_p")
    fresh = F.greatest(F.col("prompt_tokens") - F.col("cached_tokens"), F.lit(0))
    cost = (fresh * p["input"] + F.col("cached_tokens") * p["cached"] + F.col("completion_tokens") * p["output"]) / 1000
    priced = usage.withColumn("_p", price_of(F.col(model), prices))
    return priced.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("_p")


def usage_totals(usage: DataFrame, by: list[str]) -> DataFrame:
    """Sums per combination of ``by`` with subtotals from left to right (null = all)."""
    cols = ["prompt_tokens", "completion_tokens", "cached_tokens", "total_tokens", "requests"]
    return usage.rollup(*by).agg(
        F.grouping_id().cast("int").alias("level"),
        *[F.sum(c).cast("bigint").alias(c) for c in cols], F.sum("cost_usd").alias("cost_usd"),
    )
