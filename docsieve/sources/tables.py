"""Reading, writing and growing tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save_overwrite(df: DataFrame, name: str, path: str | None = None) -> None:
    """Replace the table and its schema; with a ``path`` its files lie there, else in the warehouse."""
    writer = df.write.mode("overwrite").option("overwriteSchema", "true").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def forget_table(spark: SparkSession, name: str) -> DataFrame:
    """The rows of a table with a path of its own, after its name is gone from the catalog: the files stay."""
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return rows


def save_append(df: DataFrame, path: str) -> None:
    """Append to a folder of parquet files; new columns join the schema on read."""
    df.write.mode("append").parquet(path)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Read a folder whose files may differ in columns."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def table_or_load(spark: SparkSession, name: str, load: Callable[[], DataFrame], path: str | None = None) -> DataFrame:
    """The table if it exists, else load, save (at ``path`` if given) and return it."""
    if not spark.catalog.tableExists(name):
        save_overwrite(load(), name, path)
    return spark.table(name)


def resolve_dataset(team: DataFrame, shared: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Per key: the team's value where it is set (not null, not empty), else the shared one."""
    t = team.select(key, *[F.col(c).alias(f"_t_{c}") for c in cols])
    s = shared.select(key, *[F.col(c).alias(f"_s_{c}") for c in cols])

    def pick(c: str) -> Column:
        return F.coalesce(F.when(F.col(f"_t_{c}").cast("string") != "", F.col(f"_t_{c}")), F.col(f"_s_{c}"))

    return s.join(t, key, "full_outer").select(key, *[pick(c).alias(c) for c in cols])


def team_settings(configs: DataFrame) -> DataFrame:
    """Names derived from one team config row each; a given name wins over the derived one."""
    name = F.col("agent_name")

    def given(c: str, derived: Column) -> Column:
        return F.coalesce(F.when(F.col(c) != "", F.col(c)), derived).alias(c)

    return configs.select(
        "team", "agent_name",
        given("schema", name),
        given("audit_schema", F.concat(name, F.lit("_audit"))),
        given("chatbot_name", F.concat(F.replace(name, F.lit("_"), F.lit("-")), F.lit("-chatbot"))),
    )


def _parsed(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def evolve(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """``df`` with every column of ``schema`` (missing ones null, typed), its own extra columns last."""
    schema = _parsed(schema)
    have = set(df.columns)
    declared = [
        F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    return df.select(*declared, *[c for c in df.columns if c not in set(schema.fieldNames())])


def missing_columns(df: DataFrame, schema: T.StructType | str) -> list[T.StructField]:
    """Declared columns that ``df`` lacks, complex types included."""
    return [f for f in _parsed(schema).fields if f.name not in df.columns]
