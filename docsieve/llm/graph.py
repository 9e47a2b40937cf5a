"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (larger ones, or it and its smaller ones) linked to the smallest of them."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    down = edges.select(high.alias("a"), low.alias("b"))
    rows = down.union(down.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else down
    least = rows.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = rows.join(least, "a")
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, two ids) that is not the smallest of its component.

    Large and small stars in turn until every node hangs on the smallest one.
    Each round is written; only a count and a checksum come to the driver.
    """
    current = cut_lineage(edges.where(F.col("a") != F.col("b")).select("a", "b"), "edges")
    before = None
    while True:
        current = cut_lineage(_star(_star(current, True), False), "edges")
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
        if now == before or not now[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def more_links(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root`` after ``edges`` have come to components that are known as such rows.

    Only the components that the new edges join are worked on, as nodes.
    """
    edges = cut_lineage(edges.where(F.col("a") != F.col("b")).select("a", "b"), "edges")
    for end in ("a", "b"):
        of = roots.select(F.col("node").alias(end), "root")
        edges = edges.join(of, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    merged = components(edges.distinct())
    moved = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return cut_lineage(moved.select("node", F.coalesce("top", "root").alias("root")).unionByName(merged), "roots")
