"""Building blocks that keep hot keys and large groups spread over many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.session import cut_lineage



def same(left: Column, right: Column) -> Column:
    """Null-safe equality, for keys that may be null."""
    return left.eqNullSafe(right)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which a null key meets a null key."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [same(left[k], renamed[f"_k_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_k_{k}" for k in keys])


def side_by_side(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Columns of several aggregates with at most one row per key each, put into one row per key.

    A union and a grouping: null keys meet, and without keys nothing is
    cross-joined.
    """
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    return rows.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c not in keys])


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], fine: Column) -> DataFrame:
    """Running sums per key, each key cut into ordered slices ``fine``: one way for every size of a key."""
    return running_in_slices(df.withColumn("_slice", fine), keys, "_slice", order, sums).drop("_slice")


def running_in_slices(
    df: DataFrame, keys: list[str], slice_col: str, order: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Running sums per key without ever gathering one key in one task.

    ``slice_col`` cuts each key's history into ordered slices (say, days). A
    task sorts one slice; what came before it is a running sum over slice
    totals, which number one row per key and slice.
    """
    local = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, slice_col).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    carried = totals.select(
        *keys, slice_col, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    inner = df.select("*", *[F.sum(v).over(local).alias(f"_l_{n}") for n, v in sums.items()])
    joined = join_null_safe(inner, carried, [*keys, slice_col])
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums])


def neighbours_in_slices(
    df: DataFrame, keys: list[str], slice_col: str, order: list[str], cols: list[str], ahead: bool = False
) -> DataFrame:
    """The previous (or next) row's ``cols`` per key as ``prev_*`` (``next_*``).

    Like ``lag``/``lead`` over the whole key, but a task only sorts one slice;
    the row at a slice's edge takes its neighbour from the nearest other slice.
    """
    name = "next" if ahead else "prev"
    local = Window.partitionBy(*keys, slice_col).orderBy(*order)
    shift = F.lead if ahead else F.lag
    row = F.struct(*cols)
    inner = df.withColumn("_row", row).withColumn("_near", shift("_row").over(local))
    edge_of = F.min_by if ahead else F.max_by
    edges = df.groupBy(*keys, slice_col).agg(edge_of(row, F.struct(*order)).alias("_edge"))
    over_slices = Window.partitionBy(*keys).orderBy(slice_col)
    edges = edges.select(*keys, slice_col, shift("_edge").over(over_slices).alias("_edge"))
    joined = join_null_safe(inner, edges, [*keys, slice_col])
    near = F.coalesce("_near", "_edge")
    return joined.select(*df.columns, *[near[c].alias(f"{name}_{c}") for c in cols])


def ordered_bits(v: Column) -> Column:
    """A whole number per double in the order of the doubles: sign, exponent and fraction as IEEE has them, NaN last, -0 as 0."""
    a = F.abs(v)
    near = F.floor(F.log2(a)).cast("int")
    m0 = a / F.pow(F.lit(2.0), near.cast("double"))
    # The logarithm may round over a power of two.
    e = near + F.when(m0 < 1, -1).when(m0 >= 2, 1).otherwise(0)
    fraction = (a / F.pow(F.lit(2.0), e.cast("double")) - 1) * float(1 << 52)
    bits = (
        F.when(F.isnan(v), F.lit((2047 << 52) + 1))
        .when(a == float("inf"), F.lit(2047 << 52))
        .when(a < 2.0**-1022, (a * 2.0**537 * 2.0**537).cast("bigint"))
        .otherwise((e + 1023).cast("bigint") * F.lit(1 << 52) + fraction.cast("bigint"))
    )
    return F.when(v < 0, -bits).otherwise(bits)


def from_ordered_bits(k: Column) -> Column:
    """The double of ``ordered_bits``."""
    a = F.abs(k)
    e = F.shiftright(a, 52).cast("int")
    m = 1 + a.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    v = (
        F.when(k > F.lit(2047 << 52), F.lit(float("nan")))
        .when(e == 2047, F.lit(float("inf")))
        .when(e == 0, a.cast("double") / 2.0**537 / 2.0**537)
        .otherwise(m * F.pow(F.lit(2.0), (e - 1023).cast("double")))
    )
    return F.when(k < 0, -v).otherwise(v)


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, probs: list[float], names: list[str] | None = None
) -> DataFrame:
    """Interpolated quantiles per group, exact, with no group in one task; null values do not count, NaN is the largest.

    Values are counted once, as whole numbers in the order of the doubles.
    Rounds then fix 22, 21 and 21 bits each: a round counts the next bits of
    the values that share a wanted position's bits so far, and the running
    count tells where the position goes on. A round sorts at most two to four
    million counts a position, whatever range or density the values have.
    """
    names = names or [f"p{round(p * 100)}" for p in probs]
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*groups, ordered_bits(F.col("_v")).alias("_k")).agg(F.count("*").alias("_n"))
    total = counts.groupBy(*groups).agg(F.sum("_n").alias("_all"))
    at = [(F.col("_all") - 1) * F.lit(p) for p in probs]
    spots = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), a.alias("at"), (F.ceil if up else F.floor)(a).alias("off"))
        for i, a in enumerate(at) for up in (False, True)
    ])
    # At most two positions per probability; ``_p`` holds their bits so far.
    wanted = total.select(*groups, F.lit(0).cast("bigint").alias("_p"), spots.alias("_want"))
    keys = [*groups, "_p"]
    before = None
    for shift in (42, 21, 0):
        so_far = F.lit(0).cast("bigint") if before is None else F.shiftright("_k", before)
        pool = counts.select(*groups, so_far.alias("_p"), F.shiftright("_k", shift).alias("_c"), "_n")
        if before is None:  # few counts are left when the positions come to them
            hist = join_null_safe(pool.groupBy(*keys, "_c").agg(F.sum("_n").alias("_n")), wanted, keys)
        else:  # few values belong to a position
            hist = join_null_safe(pool, wanted, keys).groupBy(*keys, "_c").agg(F.sum("_n").alias("_n"), F.first("_want").alias("_want"))
        hist = hist.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_c")) - F.col("_n"))
        here = F.filter("_want", lambda w: (w["off"] >= F.col("_before")) & (w["off"] < F.col("_before") + F.col("_n")))
        moved = F.transform(here, lambda w: F.struct(w["i"].alias("i"), w["up"].alias("up"), w["at"].alias("at"), (w["off"] - F.col("_before")).alias("off")))
        wanted = hist.select(*groups, F.col("_c").alias("_p"), moved.alias("_want")).where(F.size("_want") > 0)
        before = shift
    hit = wanted.select(*groups, from_ordered_bits(F.col("_p")).alias("_v"), F.explode("_want").alias("w"))

    def one(i: int) -> Column:
        low = F.max(F.when((F.col("w.i") == i) & ~F.col("w.up"), F.col("_v")))
        high = F.max(F.when((F.col("w.i") == i) & F.col("w.up"), F.col("_v")))
        at = F.max(F.when(F.col("w.i") == i, F.col("w.at")))
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    return hit.groupBy(*groups).agg(*[one(i).alias(n) for i, n in enumerate(names)])


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """``_rank`` from 0 in a global order (``order`` must be unique), and ``_total``.

    The rows are range-partitioned and written once, so that a later scan sees
    the same cut; a task ranks one range and adds the row counts of the ranges
    before it, of which there are as many as partitions.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    ranked = placed.join(F.broadcast(counts), "_part").withColumn("_rank", inner + F.col("_before"))
    return ranked.drop("_part", "_before")
