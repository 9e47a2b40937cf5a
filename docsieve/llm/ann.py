"""Nearest neighbours by p-stable hashing: perturbed buckets in order of estimated success, exact distances inside."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.session import cut_lineage

TABLES = 8
# Width of a bucket in standard deviations of a projection.
WIDTH = 2.0
# Vectors and queries that the fit looks at, and the recall it asks for on them.
SAMPLE = 4096
SAMPLE_QUERIES = 256
RECALL = 0.92
# Buckets of a table that a query visits at most; where they are too few for the recall, the buckets become coarser.
MOST_PROBES = 512
# Bytes of vectors, and of queries, held in one task; rows of a shelf of a small table.
TASK_BYTES = 32 << 20
SHELF_ROWS = 64


def steps_in_order(hashes: int, n: int) -> np.ndarray:
    """The ``n`` likeliest sets of one-step moves as rows of 0 and 1 over the 2 x ``hashes`` moves, nearest side first.

    A bucket is the less likely to hold a neighbour the farther the query lies
    from the sides that are crossed. The expected squares of the sorted
    distances depend on the number of hashes only, so one sequence serves all
    queries. The moves i and 2 x hashes - 1 - i are the two directions of one
    hash and exclude each other.
    """
    m, j = hashes, np.arange(1, 2 * hashes + 1)
    back = 2 * m + 1 - j
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    cost = np.where(j <= m, low, 1 - back / (m + 1) + back * (back + 1) / (4 * (m + 1) * (m + 2)))
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < n:
        total, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - i in chosen for i in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    moves = np.zeros((len(out), 2 * m), np.int64)
    for row, chosen in enumerate(out):
        moves[row, list(chosen)] = 1
    return moves


class Index:
    """Projections of all tables, and the sets of moves by which a query visits buckets."""

    def __init__(self, dim: int, length: float, hashes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        # A projection on a normal vector spreads like the vectors' length.
        self.w = WIDTH * length
        self.a = rng.standard_normal((TABLES, dim, hashes))
        self.b = rng.uniform(0, self.w, (TABLES, hashes))
        self.mult = rng.integers(1, 1 << 62, hashes) | 1
        self.moves = steps_in_order(hashes, MOST_PROBES)

    def _places(self, v: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        place = (v @ self.a[t] + self.b[t]) / self.w
        return place, np.floor(place)

    def buckets(self, v: np.ndarray, t: int) -> np.ndarray:
        """The key of each vector's bucket in table ``t``."""
        return (self._places(v, t)[1].astype(np.int64) * self.mult).sum(axis=1)

    def visited(self, v: np.ndarray, t: int) -> np.ndarray:
        """Keys of the buckets that each query visits in table ``t``, likeliest first (queries x moves)."""
        place, own = self._places(v, t)
        away = np.concatenate([place - own, own + 1 - place], axis=1)
        order = np.argsort(away, axis=1, kind="stable")
        step = np.concatenate([-self.mult, self.mult])[order]
        return (own.astype(np.int64) * self.mult).sum(axis=1)[:, None] + step @ self.moves.T


def fit(sample: np.ndarray, rows: int, k: int) -> Index:
    """Choose hashes and probes on a bounded sample: the fewest probes that reach ``RECALL`` there.

    Neighbours inside a sample are farther away than in the whole table, so
    the whole table's recall is no worse.
    """
    length = float(np.sqrt((sample**2).sum(axis=1).mean()))
    queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    near = np.argsort((sample**2).sum(axis=1) - 2 * (queries @ sample.T), axis=1, kind="stable")[:, : k + 1]
    for hashes in range(max(4, round(np.log2(max(rows, 2)) / 2)), 0, -1):
        index = Index(sample.shape[1], length, hashes)
        met = np.full(near.shape, MOST_PROBES)
        for t in range(TABLES):
            same = index.visited(queries, t)[:, None, :] == index.buckets(sample, t)[near][:, :, None]
            met = np.minimum(met, np.where(same.any(axis=2), same.argmax(axis=2), MOST_PROBES))
        needed = int(np.sort(met, axis=None)[int(np.ceil(RECALL * met.size)) - 1]) + 1
        if needed <= len(index.moves):
            index.moves = index.moves[:needed]
            break
    return index


def _vectors(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = col.combine_chunks().flatten() if isinstance(col, pa.ChunkedArray) else col.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)


def _candidates(index: Index, v: np.ndarray, sorted_keys: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray) -> np.ndarray:
    """Which vectors lie in a visited bucket of any table (queries x vectors)."""
    out = np.zeros((len(q), len(v)), bool)
    for t, (order, keys) in enumerate(sorted_keys):
        want = index.visited(q, t)
        lo, hi = np.searchsorted(keys, want, "left"), np.searchsorted(keys, want, "right")
        edge = np.zeros((len(q), len(v) + 1), np.int32)
        row, col = np.nonzero(hi > lo)
        np.add.at(edge, (row, lo[row, col]), 1)
        np.add.at(edge, (row, hi[row, col]), -1)
        out[:, order] |= np.cumsum(edge[:, :-1], axis=1) > 0
    return out


def _nearest(index: Index | None, dim: int, k: int):
    """The ``k`` nearest candidates of one shelf for each query, by exact distance, ties to the smaller id.

    Candidates are the vectors in visited buckets; without an index all.
    """

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if vectors.num_rows and queries.num_rows:
            v, ids = _vectors(vectors["v"], dim), vectors["id"].to_numpy()
            q, names = _vectors(queries["v"], dim), queries["id"].to_numpy()
            sorted_keys = []
            for t in range(TABLES if index else 0):
                keys = index.buckets(v, t)
                order = np.argsort(keys, kind="stable")
                sorted_keys.append((order, keys[order]))
            for i in range(0, len(q), 64):
                block = q[i : i + 64]
                inside = _candidates(index, v, sorted_keys, block) if index else np.ones((len(block), len(v)), bool)
                for one, name, mask in zip(block, names[i : i + 64], inside, strict=True):
                    at = np.flatnonzero(mask)
                    d = np.sqrt(((v[at] - one) ** 2).sum(axis=1))
                    if len(at) > k:
                        near = d <= np.partition(d, k - 1)[k - 1]
                        at, d = at[near], d[near]
                    best = np.lexsort((ids[at], d))[:k]
                    out.append((np.full(len(best), name), ids[at[best]], d[best]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "id", "d"])

    return run


def _search(vectors: DataFrame, queries: DataFrame, n: int, n_queries: int, index: Index | None, dim: int, k: int) -> DataFrame:
    """``q, id, d``: the nearest of each query on every shelf.

    Vectors are dealt over shelves of bounded size by a hash of their id, so no
    bucket is ever too large for a task; a vector lies on one shelf with its
    buckets of all tables, and tables are merged there. Queries come in blocks
    of bounded size.
    """
    fit_rows = max(1, TASK_BYTES // (8 * dim))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shelves = max(-(-n // fit_rows), min(tasks, -(-n // SHELF_ROWS)), 1)
    blocks = max(-(-n_queries // fit_rows), 1)

    def deal(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(own)
        return df.select("id", "v", mine, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    left, right = deal(vectors, "shelf", shelves, "block", blocks), deal(queries, "block", blocks, "shelf", shelves)
    return left.groupBy("shelf", "block").cogroup(right.groupBy("shelf", "block")).applyInArrow(_nearest(index, dim, k), "q bigint, id bigint, d double")


def _first(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= k)


def nearest(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for the rows where ``queries`` holds.

    Distances are Euclidean, in double precision on the given vectors; ties go
    to the smaller id. Rows with a null id and vectors that are null, empty,
    zero or hold null or non-finite components take no part; all others must
    have one length, the most frequent one. Rows that share an id are one row:
    it is asked if one of them is, and has the least of their vectors.

    Equal vectors are searched once: the ``k + 1`` smallest ids of a vector are
    all that an answer can hold of it. A query that finds too few rows in its
    buckets is held against all rows, in blocks.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = F.col(id_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(good & F.exists(vec_col, lambda x: x != 0)).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == size["n"])
    few = _first(rows.select("id", "v"), "v", [F.col("id")], k + 1)
    reps = cut_lineage(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]), "vectors")
    asked = rows.where("asked").select("id", "v")
    wanted = cut_lineage(asked.groupBy("v").agg(F.min("id").alias("id")), "queries")
    n, n_queries = reps.count(), wanted.count()
    # A bounded sample, the smallest by hash.
    sample = reps.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    index = fit(np.array([r["v"] for r in sample]), n, k)
    found = _search(reps, wanted, n, n_queries, index, size["n"], k + 1)
    ids = reps.select("id", "ids")
    best = cut_lineage(_first(found, "q", [F.col("d"), F.col("id")], k + 1).drop("_n").join(ids, "id"), "found")
    enough = best.groupBy("q").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > min(k, n - 1)).select(F.col("q").alias("id"))
    short = cut_lineage(wanted.join(enough, "id", "left_anti"), "short")
    n_short = short.count()
    if n_short:
        whole = _search(reps, short, n, n_short, None, size["n"], k + 1)
        whole = _first(whole, "q", [F.col("d"), F.col("id")], k + 1).drop("_n").join(ids, "id")
        best = best.join(short.select(F.col("id").alias("q")), "q", "left_anti").unionByName(whole)
    named = asked.join(wanted.withColumnRenamed("id", "q"), "v").select(F.col("id").alias("query_id"), "q")
    pairs = named.join(best.select("q", "d", F.explode("ids").alias("vec_id")), "q").where(F.col("vec_id") != F.col("query_id"))
    ranked = _first(pairs, "query_id", [F.col("d"), F.col("vec_id")], k)
    return ranked.select("query_id", F.col("_n").alias("rank"), "vec_id", F.col("d").alias("score"))
