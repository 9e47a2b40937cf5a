"""Exact copies: sorted digest runs merged in rounds up a tree, the winners handed back down it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.session import cut_lineage

# Runs merged into one per round.
FAN_IN = 16
_KEY = ["digest", "check", "n_normal"]


def normalised(c: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _merge(runs: DataFrame, fan_in: int) -> DataFrame:
    """One round: every ``fan_in`` neighbouring runs become one, with the best row and the size of each digest."""
    up = F.floor(F.col("run") / fan_in).cast("int").alias("run")
    return runs.groupBy(up, *_KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """Every row with the row that stays of its group: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when equal after ``normalised``. The longest original text
    stays, then the smallest id (a null id comes last); of repeated rows with
    one id, exactly one stays. A digest is SHA-256, and equal digests are held
    against the length and a second hash of the text before they merge.

    Each input partition is a run. A round merges ``fan_in`` runs into one, by
    digest, so that a digest met in many partitions reaches the next round as
    one row each; winners go back the same way, and no task ever holds all
    copies of a text.
    """
    text = normalised(F.col(text_col))
    leaves = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"),
        text.alias("_text"),
    ).select(
        "doc_id", "n_chars", F.unhex(F.sha2("_text", 256)).alias("digest"), F.xxhash64("_text").alias("check"), F.length("_text").alias("n_normal"),
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"),
    )
    leaves = cut_lineage(leaves, "digests")
    best = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    levels = [cut_lineage(leaves.groupBy("run", *_KEY).agg(F.min(best).alias("best"), F.count("*").alias("n")), "runs")]
    count = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    while count > 1:
        levels.append(cut_lineage(_merge(levels[-1], fan_in), "runs"))
        count = -(-count // fan_in)

    won = levels[-1].select("run", *_KEY, F.col("best").alias("_best"), F.col("n").alias("_n"))
    for below in reversed(levels[:-1]):
        up = won.withColumnRenamed("run", "_up")
        at = below.select("run", *_KEY, F.floor(F.col("run") / fan_in).cast("int").alias("_up"))
        won = at.join(up, ["_up", *_KEY]).select("run", *_KEY, "_best", "_n")
    out = leaves.join(won, ["run", *_KEY])
    return out.select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("row") == F.col("_best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
