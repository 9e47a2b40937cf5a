"""Mixing sources to target weights: shares by water level, cuts by running sums in a random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.prefix import prefix_sums
from docsieve.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
WORD = r"[^\x20\x09-\x0D]+"


def n_words(c: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, source_col: str, size_col: str, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS
) -> DataFrame:
    """``source_size`` and ``target`` of every source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times the total size. A target stops at ``epochs`` times its
    source; the excess goes to the others by weight until none is above. That
    is one level per unit of weight, found with running sums over the sources
    in the order in which they fill up.
    """
    per = sizes.groupBy(source_col).agg(F.sum(size_col).alias("source_size"), F.lit(1).alias("_one"))
    per = per.withColumn("_null", F.col(source_col).isNull())
    ranked = prefix_sums(per, [], ["_null", source_col], ["_one"])
    turn = F.pmod(F.col("_one_before"), F.lit(len(weights))).cast("int")
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("bigint"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * epochs).drop("_one_before")
    ranked = cut_lineage(ranked, "sources")
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    filling = ranked.withColumn("_full_at", F.col("_cap") / F.col("_weight"))
    filling = prefix_sums(filling, [], ["_full_at", "_null", source_col], ["_cap", "_weight"])
    level = (F.lit(float(total * share)) - F.col("_cap_before")) / (F.lit(weight) - F.col("_weight_before"))
    filling = cut_lineage(filling.withColumn("_level", level), "filling")
    open_ = filling.where(F.col("_cap") > F.col("_level") * F.col("_weight"))
    water = open_.agg(F.min_by("_level", F.struct("_full_at", "_null", source_col))).first()[0]
    poured = F.col("_cap").cast("double")
    if water is not None:
        poured = F.least(poured, F.lit(water) * F.col("_weight"))
    return filling.select(source_col, "source_size", poured.alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, keep: list[str] | None = None,
) -> DataFrame:
    """How many words of every document the mix takes: ``size, source_size, target, taken``.

    Documents of a source stand in the order of a hash of their id. The words
    before each are a running sum; whole epochs are taken of every document,
    and the last, partial epoch ends at exactly the budget, inside a document
    if need be. The sum of ``taken`` is the target without its fraction.

    Null text has size 0. A null source is a source of its own, the last. Rows
    without an id are ordered by their size; repeated rows count each. Columns
    in ``keep`` ride along.
    """
    size = n_words(F.col(text_col))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("_source"), size.alias("size"), key.alias("_key"), *(keep or []))
    placed = prefix_sums(rows, ["_source"], ["_key", "doc_id", "size"], ["size"])
    placed = cut_lineage(placed, "placed")
    targets = source_targets(placed.select("_source", "size"), "_source", "size", weights, share, epochs)
    targets = targets.withColumnRenamed("_source", "_of")
    both = placed.join(targets, placed["_source"].eqNullSafe(targets["_of"]))
    budget = F.floor("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("size_before")))
    return both.select(
        "doc_id", F.col("_source").alias("source"), "size", "source_size", "target",
        (whole * F.col("size") + part).cast("bigint").alias("taken"), *(keep or []),
    )


def repeat_taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """``docs`` as the mix takes them: whole rows, as often as the words taken come to when rounded.

    Only ids, sizes and a fingerprint are sorted; texts meet their number by id
    and fingerprint. Repeated rows share their number evenly. Other columns
    ride along under any name.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    names, docs = docs.columns, plain
    id_col, source_col, text_col = (f"c{names.index(n)}" for n in (id_col, source_col, text_col))
    print_ = F.xxhash64(text_col, source_col)
    taken = mix(docs.select(id_col, source_col, text_col, print_.alias("_fp")), id_col, source_col, text_col, keep=["_fp"], **how)
    times = taken.groupBy(F.col("doc_id").alias("_id"), F.col("_fp").alias("_of")).agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    times = times.withColumn("_times", F.when(F.col("_size") > 0, F.round(F.col("_taken") / F.col("_size"))).otherwise(F.lit(0)).cast("int"))
    rows = docs.withColumn("_fp", print_)
    both = rows.join(times.where(F.col("_times") > 0), rows[id_col].eqNullSafe(times["_id"]) & (rows["_fp"] == times["_of"]))
    return both.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns).toDF(*names)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS k FROM documents
), p AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source
), f AS (
  SELECT *, 2 * source_size AS cap, 2 * source_size / w AS full_at FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE)
            / ((SELECT sum(w) FROM s)::DOUBLE - coalesce(sum(w) OVER b, 0)::DOUBLE) AS level
  FROM f WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT arg_min(level, full_at) AS level FROM l WHERE cap > level * w
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM water) * w, cap::DOUBLE)) AS target FROM f
), c AS (
  SELECT p.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken FROM c
"""
