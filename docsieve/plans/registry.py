"""Registry of runnable queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsieve.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same result for a SQL engine, if SQL can say it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the splits that the session's settings give."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table for queries that are bound by work on its texts.

    A file of one row group is one task, however many cores there are. A
    session that reads such files names in ``spark.docsieve.text.partitions`` over
    how many tasks the rows are dealt before the work; unset, rows stay in the
    splits of the scan.
    """
    df = table(spark, sf_dir, name)
    tasks = spark.conf.get("spark.docsieve.text.partitions", None)
    return df.repartition(int(tasks)) if tasks else df
