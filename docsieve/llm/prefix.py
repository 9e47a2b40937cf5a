"""Running sums in a global order that no single task has to sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators.scale import join_null_safe
from docsieve.session import cut_lineage


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Add ``<name>_before`` for each name in ``sums``: its sum over earlier rows of the same keys.

    Rows are range-partitioned by keys and order and written once, so that
    later reads see the same ranges. A task sums one range; what came before
    is a running sum over one row per range and key.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_all_{c}") for c in sums])
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_base_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = join_null_safe(ranged, totals, [*keys, "_range"])
    return both.select(*df.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_base_{c}")).alias(f"{c}_before") for c in sums])
