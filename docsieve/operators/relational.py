"""Joins by similarity, hierarchies, rolling statistics, forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators.scale import running
from docsieve.session import cut_lineage


def hierarchy(nodes: DataFrame, node: list[str], parent: list[str], max_depth: int | None = None) -> DataFrame:
    """``nodes`` reachable from the roots (null parent), with ``depth`` from 0; up to ``max_depth`` if given.

    Pointer doubling: in every round each node learns of an ancestor twice as
    far up, so a tree of n levels takes log2(n) rounds. Only ids and distances
    are joined and written, once a round. A node whose chain of parents ends
    outside the table is left out. Ids are unique within ``node``'s columns. A
    cycle raises an error; with ``max_depth`` longer chains are not followed,
    so the nodes of a cycle are left out.
    """
    width = range(len(node))
    own, up, top = ([f"_{m}{i}" for i in width] for m in "nat")
    child = F.col(parent[-1]).isNotNull()
    edges = nodes.where(child).select(*[F.col(c).alias(o) for c, o in zip([*node, *parent], [*own, *up])]).distinct()
    roots = nodes.where(~child).select(*[F.col(c).alias(t) for c, t in zip(node, top)], F.lit(True).alias("_root")).distinct()
    start = edges.select("*", *[F.col(u).alias(t) for u, t in zip(up, top)], F.lit(1).alias("_d")).join(roots, top, "left")
    state = cut_lineage(start.select(*own, *up, *top, "_d", F.coalesce("_root", F.lit(False)).alias("_root")), "edges")
    reach, longest = 1, None
    while max_depth is None or reach < max_depth:
        if state.where(~F.col("_root")).isEmpty():
            break
        longest = state.count() if longest is None else longest
        if max_depth is None and reach > longest:
            raise ValueError("the hierarchy has a cycle")
        known = state.select(
            *[F.col(o).alias(t) for o, t in zip(own, top)], *[F.col(t).alias(f"_next{t}") for t in top], F.col("_d").alias("_e"), F.col("_root").alias("_to_root")
        )
        moved = state.where(~F.col("_root")).drop("_root").join(known, top).select(
            *own, *up, *[F.col(f"_next{t}").alias(t) for t in top], (F.col("_d") + F.col("_e")).alias("_d"), F.col("_to_root").alias("_root")
        )
        state = cut_lineage(state.where("_root").union(moved), "edges")
        reach *= 2
    depths = state.where("_root").select(*own, *up, F.col("_d").alias("depth")).distinct()
    # A child's own id may be null; it is a leaf then.
    on = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(node, own)] + [F.col(c) == F.col(u) for c, u in zip(parent, up)]
    placed = nodes.where(child).join(depths, reduce(lambda x, y: x & y, on)).select(*nodes.columns, "depth")
    if max_depth is not None:
        placed = placed.where(F.col("depth") <= max_depth)
    return nodes.where(~child).withColumn("depth", F.lit(0)).unionByName(placed)


def _allowed_edits(longest: Column, max_distance: int, min_score: float) -> Column:
    """How many edits a pair may have whose longer string has that many characters."""
    if min_score <= 0:
        return F.lit(max_distance)
    return F.least(F.lit(max_distance), F.floor((1.0 - min_score) * longest + 1e-9).cast("int"))


# Up to this length a string's deletions are few, and tell more apart than a segment of it would.
SHORT = 24


def _deletion_keys(c: Column, max_distance: int, min_score: float) -> Column:
    """Keys of the string and of what is left after dropping as many characters as a partner of any close length may ask for."""
    edits = _allowed_edits(F.length(c) + max_distance, max_distance, min_score)
    out = F.array(c)
    for n in range(1, max_distance + 1):
        cut = lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
            lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
        )
        out = F.when(edits >= n, F.array_distinct(F.concat(out, F.flatten(F.transform(out, cut))))).otherwise(out)
    return F.transform(out, lambda s: F.xxhash64(F.lit(-1), s))


def _segment(n: Column, edits: int, i: int) -> tuple[Column, Column]:
    """Place (from 0) and length of segment ``i`` when ``n`` characters are cut into ``edits + 1`` even parts, longer ones last."""
    parts = edits + 1
    short = F.floor(n / parts).cast("int")
    ahead = F.lit(i) - (parts - n % parts)
    return i * short + F.greatest(ahead, F.lit(0)), short + F.when(ahead >= 0, 1).otherwise(0)


def _segment_keys(c: Column, max_distance: int, min_score: float) -> Column:
    """Keys of a string's own segments, for every number of edits that a partner's length may allow."""
    n, keys = F.length(c), []
    for e in range(max_distance + 1):
        allowed = [_allowed_edits(n + more, max_distance, min_score) == e for more in range(max_distance + 1)]
        some = reduce(lambda x, y: x | y, allowed)
        for i in range(e + 1):
            at, size = _segment(n, e, i)
            keys.append(F.when(some, F.xxhash64(F.lit(e), n, F.lit(i), F.substring(c, at + 1, size))))
    return F.when(n <= SHORT, _deletion_keys(c, max_distance, min_score)).otherwise(F.array_compact(F.array(*keys)))


def _probe_keys(c: Column, max_distance: int, min_score: float) -> Column:
    """Keys under which a similar string of any close length is found.

    Segment i of a string of n characters lies at most i places off in a
    similar one before the i-th edit, and at most ``edits - i`` off counted
    from the end, so few places are asked for, however long the string.
    """
    m, keys = F.length(c), []
    for e in range(max_distance + 1):
        for longer in range(-e, e + 1):  # how much longer this string is
            n = m - longer
            fits = (n > SHORT) & (_allowed_edits(F.greatest(n, m), max_distance, min_score) == e)
            for i in range(e + 1):
                at, size = _segment(n, e, i)
                for off in range(max(-i, longer - (e - i)), min(i, longer + (e - i)) + 1):
                    place = at + off
                    inside = fits & (place >= 0) & (place + size <= m)
                    keys.append(F.when(inside, F.xxhash64(F.lit(e), n, F.lit(i), F.substring(c, place + 1, size))))
    near = F.when(m <= SHORT + max_distance, _deletion_keys(c, max_distance, min_score)).otherwise(F.array().cast("array<bigint>"))
    far = F.when(m > SHORT - max_distance, F.array_distinct(F.array_compact(F.array(*keys)))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(near, far)


def fuzzy_join(left: DataFrame, right: DataFrame, l: str, r: str, max_distance: int = 1, min_score: float = 0.0) -> DataFrame:
    """Distinct values of both sides within ``max_distance`` edits: ``left_value, right_value, distance, score``.

    Exact. Strings of up to ``SHORT`` characters that close share a string left
    after as many deletions. A longer one cut into d + 1 parts keeps one of them
    unchanged within d edits, so length, number and text of a part find every
    pair with a number of keys that does not depend on the length. ``min_score``
    lowers the edits that short strings are allowed before the join. Strings of
    no more than d characters are all close to each other, and all come out.
    Copies of a value are joined once; counts come back by joining on the value.
    """
    a = left.select(F.col(l).alias("left_value")).where(F.col(l).isNotNull()).distinct()
    b = right.select(F.col(r).alias("right_value")).where(F.col(r).isNotNull()).distinct()
    a = a.withColumn("_k", F.explode(_segment_keys(F.col("left_value"), max_distance, min_score)))
    b = b.withColumn("_k", F.explode(_probe_keys(F.col("right_value"), max_distance, min_score)))
    distance = F.levenshtein("left_value", "right_value", max_distance)
    near = a.join(b, "_k").select("left_value", "right_value", distance.alias("distance")).where(F.col("distance") >= 0).distinct()
    longest = F.greatest(F.length("left_value"), F.length("right_value"), F.lit(1))
    return near.withColumn("score", 1.0 - F.col("distance") / longest).where(F.col("score") >= min_score)


def rolling_outliers(
    df: DataFrame, key: str, order: list[str], fine: Column, value: str, rows: int = 100, sigmas: float = 3.0, block: int = 10_000,
) -> DataFrame:
    """Add ``mean``, ``std`` over the last ``rows`` rows and the current one, and ``is_outlier``.

    A key's rows are numbered in slices ``fine`` and cut into blocks; each
    block also gets the ``rows`` rows before it, so no key is one task's work.
    """
    if rows > block:
        raise ValueError("block must hold at least the rows of one frame")
    numbered = running(df, [key], order, {"_n": F.lit(1)}, fine).withColumn("_n", F.col("_n") - 1)
    own = F.struct(F.floor(F.col("_n") / block).alias("b"), F.lit(False).alias("extra"))
    ahead = F.struct((F.floor(F.col("_n") / block) + 1).alias("b"), F.lit(True).alias("extra"))
    near_end = F.col("_n") % block >= block - min(rows, block)
    placed = numbered.withColumn("_p", F.explode(F.when(near_end, F.array(own, ahead)).otherwise(F.array(own))))
    frame = Window.partitionBy(key, "_p.b").orderBy("_n").rowsBetween(-rows, 0)
    judged = placed.withColumns({"mean": F.avg(value).over(frame), "std": F.stddev_pop(value).over(frame)}).where(~F.col("_p.extra"))
    return judged.withColumn("is_outlier", F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("std")).drop("_p", "_n")


def sample_rows(df: DataFrame, keys: list[str], fraction: float, seed: int) -> DataFrame:
    """A share of the rows by a hash of their keys: the same rows in every run and partitioning."""
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return df.where(F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("bigint") < int(fraction * 2**32))


def forecast(daily: DataFrame, keys: list[str], day: str, value: str, horizon: int, z: float = 1.96) -> DataFrame:
    """A linear trend per group, ``horizon`` days ahead: ``keys, day, forecast, lower, upper``.

    Six sums per group are enough for the trend and its spread.
    """
    x = F.date_diff(F.col(day), F.lit("1970-01-01").cast("date")).cast("double")
    fit = daily.select(*keys, x.alias("x"), F.col(value).cast("double").alias("y")).groupBy(*keys).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.count("*").alias("n"),
        F.max("x").cast("int").alias("last"),
    )
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    fit = fit.withColumn("_sd", F.sqrt(rest / F.nullif(F.col("n") - 2, F.lit(0))))
    ahead = fit.withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    y = F.col("base") + F.col("slope") * (F.col("last") + F.col("_h"))
    at = F.date_add(F.lit("1970-01-01").cast("date"), F.col("last") + F.col("_h"))
    return ahead.select(*keys, at.alias("day"), y.alias("forecast"), (y - z * F.col("_sd")).alias("lower"), (y + z * F.col("_sd")).alias("upper"))
