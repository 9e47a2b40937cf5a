"""Seeded test data, injected faults and their detection, row-level expectations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category weights and the log-normal (mean, sigma) of the amounts.
TIERS = {"Free": 0.6, "Pro": 0.3, "Enterprise": 0.1}
AMOUNTS = {"Enterprise": (7.5, 0.8), "Pro": (5.5, 0.7), "Free": (4.0, 0.6)}
STATUSES = {"delivered": 0.65, "shipped": 0.15, "processing": 0.10, "pending": 0.05, "cancelled": 0.05}
SEED = 42


def uniform(key: Column, salt: int) -> Column:
    """A number in (0, 1) that depends on the key and the salt only, not on the partitioning."""
    bits = F.conv(F.left(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), F.lit(13)), 16, 10)
    return (bits.cast("bigint").cast("double") + 0.5) / float(2**52)


def weighted(u: Column, weights: dict[str, float]) -> Column:
    """A category from a uniform number."""
    names = list(weights)
    upto, out = 0.0, None
    for n in names[:-1]:
        upto += weights[n]
        out = F.when(u < upto, n) if out is None else out.when(u < upto, n)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def log_normal(u1: Column, u2: Column, mean: Column, sigma: Column) -> Column:
    z = F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * math.pi * u2)
    return F.exp(mean + sigma * z)


def amount(key: Column, tier: Column, salt: int, places: int = 2) -> Column:
    """A skewed amount around the tier's level."""
    mean = F.coalesce(*[F.when(tier == t, F.lit(m)) for t, (m, _) in AMOUNTS.items()], F.lit(AMOUNTS["Free"][0]))
    sigma = F.coalesce(*[F.when(tier == t, F.lit(s)) for t, (_, s) in AMOUNTS.items()], F.lit(AMOUNTS["Free"][1]))
    return F.round(log_normal(uniform(key, salt), uniform(key, salt + 1), mean, sigma), places)


def master_table(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """``n`` customers: id, tier, region, yearly amount."""
    return master_of(spark.range(n), "id", seed)


def master_of(ids: DataFrame, key: str, seed: int = SEED, places: int = 2) -> DataFrame:
    """Customers for given whole-number ids."""
    k = F.col(key)
    tier = weighted(uniform(k, seed), TIERS)
    region = weighted(uniform(k, seed + 1), {"North": 0.4, "South": 0.25, "East": 0.2, "West": 0.15})
    rows = ids.select(
        k.alias("customer_idx"), F.format_string("CUST-%05d", k).alias("customer_id"), tier.alias("tier"), region.alias("region")
    )
    return rows.withColumn("arr", amount(F.col("customer_idx"), F.col("tier"), seed + 2, places))


def child_table(ids: DataFrame, key: str, masters: DataFrame, n_masters: int, seed: int = SEED) -> DataFrame:
    """Orders whose customer exists: a hash of the order picks a customer index below ``n_masters``."""
    k = F.col(key)
    rows = ids.select(
        F.format_string("ORD-%06d", k).alias("order_id"), k.alias("order_idx"),
        F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(n_masters)).alias("customer_idx"),
        weighted(uniform(k, seed + 5), STATUSES).alias("status"),
    )
    joined = rows.join(masters.select("customer_idx", "customer_id", "tier"), "customer_idx", "left").drop("customer_idx")
    return joined.withColumn("amount", amount(F.col("order_idx"), F.col("tier"), seed + 6))


def inject_faults(df: DataFrame, key: Column, shares: dict[str, float], fk: str, value: str, orphan: Column) -> DataFrame:
    """Null keys, impossible amounts and orphan keys in disjoint, fixed shares of the rows.

    ``key`` is a number in [0, 1) per row, such as :func:`uniform` of its id.
    """
    a = shares.get("null_key", 0.0)
    b = a + shares.get("bad_amount", 0.0)
    c = b + shares.get("orphan", 0.0)
    return df.withColumns({
        fk: F.when(key < a, F.lit(None)).when((key >= b) & (key < c), orphan).otherwise(F.col(fk)),
        value: F.when((key >= a) & (key < b), F.lit(-1.0) * F.abs(F.col(value))).otherwise(F.col(value)),
    })


def detect_faults(df: DataFrame, fk: str, value: str, masters: DataFrame, master_key: str) -> DataFrame:
    """``issue, rows``: missing keys, amounts out of range, keys without a master row."""
    n = lambda hit: F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).cast("bigint")
    flags = df.agg(n(F.col(fk).isNull()).alias("null_key"), n(F.col(value) < 0).alias("bad_amount"))
    local = flags.unpivot([], ["null_key", "bad_amount"], "issue", "rows")
    # Keys are counted first: a hot orphan key is one row in the join.
    keys = df.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k")).agg(F.count("*").alias("_n"))
    orphans = keys.join(masters.select(F.col(master_key).alias("_k")), "_k", "left_anti")
    orphans = orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).select(F.lit("orphan").alias("issue"), "rows")
    return local.unionByName(orphans)


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows and share per category, largest first."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.col("n").desc(), col)


# ---------------------------------------------------------------- expectations


def with_expectations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``warn``: every row stays, ``failed_rules`` lists what it breaks (null counts as broken)."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.withColumn("failed_rules", F.filter(broken, lambda x: x.isNotNull()))


def drop_failing(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``drop``: only rows that meet every rule."""
    return with_expectations(df, rules).where(F.size("failed_rules") == 0).drop("failed_rules")


def fail_on(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``fail``: the job stops at the first row that breaks a rule."""
    checked = with_expectations(df, rules)
    message = F.concat(F.lit("expectation failed: "), F.array_join("failed_rules", ", "))
    # raise_error sits in a filter, so it runs whatever columns are read later.
    return checked.where(F.when(F.size("failed_rules") == 0, True).otherwise(F.raise_error(message).cast("boolean"))).drop("failed_rules")


def expectation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, passed, failed`` in one scan."""
    flat = df.select(*[F.when(F.coalesce(ok, F.lit(False)), 1).otherwise(0).alias(n) for n, ok in rules.items()])
    sums = flat.agg(F.count("*").cast("bigint").alias("_rows"), *[F.sum(n).cast("bigint").alias(n) for n in rules])
    return sums.unpivot("_rows", list(rules), "rule", "passed").select("rule", "passed", (F.col("_rows") - F.col("passed")).alias("failed"))


def parse_or_rescue(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Add ``parsed`` and ``rescued``: the raw text where it does not fit the schema."""
    parsed = F.from_json(F.col(col), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = df.withColumn("_p", parsed)
    bad = F.col("_p")["_bad"]
    return out.withColumns({"parsed": F.when(bad.isNull(), F.col("_p").dropFields("_bad")), "rescued": bad}).drop("_p")


def split_errors(df: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error: the main table and the error side table."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())
