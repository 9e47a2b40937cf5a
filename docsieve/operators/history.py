"""Change data: latest rows, slowly changing dimensions, merges, as-of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators.scale import join_null_safe, neighbours_in_slices
from docsieve.session import cut_lineage


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order``. An aggregate, so a hot key combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*df.columns)


def scd1(changes: DataFrame, keys: list[str], sequence: list[str], deleted: Column) -> DataFrame:
    """Current rows: the latest change per key, keys whose latest change is a delete are gone."""
    flagged = changes.withColumn("_del", F.coalesce(deleted, F.lit(False)))
    return latest_per_key(flagged, keys, sequence).where(~F.col("_del")).drop("_del")


def scd2(
    changes: DataFrame, keys: list[str], at: str, tie: str, tracked: list[str], deleted: Column | None = None, slice_of: Column | None = None,
) -> DataFrame:
    """History ``keys, tracked, start_at, end_at`` (null = current); a row per run of equal tracked values.

    A key's changes are cut into slices of time (months unless given), and a
    change at a slice's edge meets its neighbour through one row a slice, so a
    hot key is spread over tasks.
    """
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    rows = changes.select(*keys, F.col(at).alias("start_at"), F.col(tie).alias("_tie"), *tracked, gone.alias("_del"))
    rows = rows.withColumns({"_state": F.struct(*tracked, "_del"), "_seen": F.lit(True)})
    rows = rows.withColumn("_slice", F.date_trunc("month", "start_at") if slice_of is None else slice_of)
    order = ["start_at", "_tie"]
    before = neighbours_in_slices(rows, keys, "_slice", order, ["_state", "_seen"])
    runs = before.where(F.col("prev__seen").isNull() | ~F.col("_state").eqNullSafe(F.col("prev__state")))
    runs = cut_lineage(runs.drop("prev__state", "prev__seen", "_state", "_seen"), "runs")  # read twice below
    after = neighbours_in_slices(runs, keys, "_slice", order, ["start_at"], ahead=True)
    return after.where(~F.col("_del")).select(*keys, *tracked, "start_at", F.col("next_start_at").alias("end_at"))


def current(history: DataFrame) -> DataFrame:
    return history.where(F.col("end_at").isNull())


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """The state at a point in time."""
    return history.where((F.col("start_at") <= at) & (F.col("end_at").isNull() | (F.col("end_at") > at)))


def days_active(history: DataFrame, until: Column) -> DataFrame:
    """Days each version was in force, up to ``until`` for the current one."""
    return history.withColumn("days_active", F.date_diff(F.coalesce("end_at", until), F.col("start_at")))


def join_as_of(facts: DataFrame, history: DataFrame, keys: list[str], at: str, how: str = "left") -> DataFrame:
    """Each fact with the version in force at its time; versions of a key follow each other without overlap.

    Facts and versions are put into one order by key and time and cut into
    ranges, written once. Inside a range the last version of the key is carried
    to the facts after it; a key that goes on in the next range takes the last
    version of the ranges before, of which there is one row a range. So a hot
    key lies in many ranges, and neither a version without end nor a fact in
    the far future makes more rows. A null key or time meets no version.
    """
    cols = [c for c in history.columns if c not in [*keys, "start_at", "end_at"]]
    by = [f"_k{i}" for i in range(len(keys))]
    known = [F.col(k).alias(b) for k, b in zip(keys, by)]
    # A version comes before facts of the same time; of versions with one start the last to end comes last.
    left = facts.select(*known, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*facts.columns).alias("_fact"))
    right = history.select(*known, F.col("start_at").alias("_at"), F.lit(0).alias("_kind"), F.struct("start_at", "end_at", *cols).alias("_version"))
    both = left.unionByName(right, allowMissingColumns=True)
    ranges = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(both.repartitionByRange(ranges, *by, "_at").withColumn("_range", F.spark_partition_id()), "as_of")
    order = [F.col("_at"), F.col("_kind"), F.col("_version.end_at").asc_nulls_last()]
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = ranged.withColumn("_near", F.last("_version", ignorenulls=True).over(inside))
    # Only the first key of a range can come from the one before, only its last key can go on in the next: a row a range.
    key = F.struct(*by)
    edges = ranged.groupBy("_range").agg(F.min(key).alias("_first"), F.max(key).alias("_end"))
    newest = F.max_by("_version", F.struct("_at", F.col("_version.end_at").isNull(), "_version.end_at"))
    same_key = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_end.{k}")) for k in by])
    ends = ranged.where(F.col("_kind") == 0).join(F.broadcast(edges), "_range").where(same_key).groupBy("_range", *by).agg(newest.alias("_last"))
    rows = ends.unionByName(edges.select("_range", "_first.*"), allowMissingColumns=True).groupBy("_range", *by).agg(F.first("_last", ignorenulls=True).alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.select("_range", *by, F.last("_last", ignorenulls=True).over(earlier).alias("_carried")).where(F.col("_carried").isNotNull())
    # No more rows than twice the ranges.
    joined = join_null_safe(near.where(F.col("_kind") == 1).drop("_version"), F.broadcast(carried), ["_range", *by], "left")
    v = F.coalesce("_near", "_carried")
    keyed = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in by])
    holds = keyed & F.col("_at").isNotNull() & (v["end_at"].isNull() | (v["end_at"] > F.col("_at"))) & v["start_at"].isNotNull()
    found = joined.withColumn("_v", F.when(holds, v))
    if how == "inner":
        found = found.where(F.col("_v").isNotNull())
    elif how != "left":
        raise ValueError("how must be left or inner")
    return found.select("_fact.*", *[F.col(f"_v.{c}").alias(c) for c in ("start_at", "end_at", *cols)])


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], deleted: Column | None = None) -> DataFrame:
    """The target after a merge: matched rows replaced, new ones added, deletes removed.

    ``source`` holds one row per key. Matching is null-safe. Columns that only
    the source has (such as an operation code) are not stored.
    """
    flagged = source.withColumn("_del", F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False))
    kept = join_null_safe(target, flagged.select(*keys), keys, "left_anti")
    return kept.unionByName(flagged.where(~F.col("_del")).select(*target.columns))


def trailing_distinct(df: DataFrame, day: str, value: str, days: int) -> DataFrame:
    """Per day with data: distinct values over that day and the ``days - 1`` before it.

    A window cannot count distinct values and a range join would emit every
    pair. Instead each value counts from a day it occurs on until ``days``
    later or until it occurs again; starts and ends are summed up by day.
    """
    once = df.select(F.to_date(F.col(day)).alias("day"), F.col(value).alias("v")).distinct()
    again = F.lead("day").over(Window.partitionBy("v").orderBy("day"))  # at most one row per value and day
    spans = once.select("day", F.least(F.date_add("day", days), F.coalesce(again, F.date_add("day", days))).alias("stop"))
    starts = spans.groupBy("day").agg(F.count("*").alias("n"), F.lit(True).alias("present"))
    stops = spans.groupBy(F.col("stop").alias("day")).agg((-F.count("*")).alias("n"), F.lit(False).alias("present"))
    moves = starts.unionByName(stops).groupBy("day").agg(F.sum("n").alias("n"), F.max("present").alias("present"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar day
    return moves.withColumn("distinct_values", F.sum("n").over(upto)).where("present").select("day", "distinct_values")


def daily_measures(df: DataFrame, ts: str, value: str, trailing: int = 7) -> DataFrame:
    """Daily sums with running total, trailing sum without the current day, day-over-day change, year to date.

    The windows run over one row per day.
    """
    daily = df.groupBy(F.to_date(F.col(ts)).alias("day")).agg(F.sum(value).alias("total"))
    number = F.date_diff("day", F.lit("1970-01-01").cast("date"))
    d = daily.withColumn("_n", number)
    order = Window.orderBy("_n")
    return d.select(
        "day", "total",
        F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("running_total"),
        F.sum("total").over(order.rangeBetween(-trailing, -1)).alias("trailing_total"),
        (F.col("total") - F.sum("total").over(order.rangeBetween(-1, -1))).alias("day_over_day"),
        F.sum("total").over(Window.partitionBy(F.year("day")).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)).alias("year_to_date"),
    )
