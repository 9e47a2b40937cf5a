"""Ranking chunks for a table of queries: vector, keyword and hybrid top-k, and what follows it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docsieve.functions.text import tokens
from docsieve.session import cut_lineage

# Texts of the assembled context.
SOURCE_HEAD, SOURCE_GLUE, NO_SOURCE = "[Source {}] ", "\n\n---\n\n", "No relevant documentation found."

DIGITS = 6  # scores are rounded before they are compared, so that ties do not hang on summation order
BLOCK_BYTES = 32 << 20  # vectors of one side that a task holds, about
GRID_BLOCKS = 8  # blocks of less than BLOCK_BYTES that a side is cut into at most
CELLS = 4_000_000  # scores a task holds at a time
PIVOTS = 64  # vectors that the others are grouped around
POSTING_TERMS = 1_000_000  # terms of the documents in one posting block, about
QUERY_TERMS = 10_000  # terms of the queries in one block, about


# ---------------------------------------------------------------- embeddings


def hashed_tf(c: Column, dim: int = 64) -> Column:
    """Term counts hashed into ``dim`` cells. Hashing runs in the JVM, counting on Arrow batches."""

    @F.pandas_udf("array<double>")
    def cells(batch: pd.Series) -> pd.Series:
        lengths = batch.map(len).to_numpy(dtype=np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *batch]).astype(np.int64)
        counts = np.bincount(np.repeat(np.arange(len(batch)), lengths) * dim + flat, minlength=len(batch) * dim)
        return pd.Series(list(counts.reshape(len(batch), dim).astype(float)))

    return cells(F.transform(tokens(c), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int")))


def embed(df: DataFrame, col: str, fn: Callable[[Column], Column] = hashed_tf, out: str = "embedding") -> DataFrame:
    """Add a vector column. ``fn`` turns a text column into an array column: an expression or an Arrow UDF."""
    return df.withColumn(out, fn(F.coalesce(F.col(col), F.lit(""))))


# ---------------------------------------------------------------- top-k by cosine


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in col])


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` rows per query; equal scores go to the smaller id."""
    return found.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)


def _top(scores: np.ndarray, qids: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> pd.DataFrame:
    """Top ``k`` ids per query of a (queries x ids) score matrix, none below the query's floor."""
    hit = scores >= floor[:, None]
    if k < len(ids):
        hit &= scores >= np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
    row, col = np.nonzero(hit)
    return _best(pd.DataFrame({"query_id": qids[row], "id": ids[col], "score": scores[row, col]}), k)


def search_block(
    qids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, pivots: np.ndarray, k: int, seen: dict[str, int] | None = None
) -> pd.DataFrame:
    """The best ``k`` of unit (or zero) vectors ``c`` for each of the unit vectors ``q``.

    Vectors are grouped around their nearest pivot. By the triangle inequality
    none of a group is closer to a query than the pivot's distance less the
    group's radius; a group is skipped where that cannot reach the k-th best
    score so far. A query begins with its most promising group. ``seen`` counts
    pairs of queries and groups, and those that were scored.
    """
    seen = seen if seen is not None else {}
    zero = ~c.any(axis=1)
    near = np.concatenate([(c[i : i + 10_000] @ pivots.T).argmax(axis=1) for i in range(0, len(c), 10_000)]) if len(pivots) else np.zeros(len(c), int)
    near[zero] = len(pivots)
    order = np.argsort(near, kind="stable")
    names, first = np.unique(near[order], return_index=True)
    upto = np.append(first[1:], len(order))
    bound = np.zeros((len(q), len(names)))
    for g, name in enumerate(names):
        if name < len(pivots):
            radius = np.sqrt(((c[order[first[g] : upto[g]]] - pivots[name]) ** 2).sum(axis=1).max())
            cosine = q @ pivots[name]
            far = np.maximum(np.sqrt(np.maximum(2 - 2 * cosine, 0)) - radius, 0)
            bound[:, g] = np.minimum(cosine + radius, 1 - far**2 / 2)
    bound[~q.any(axis=1)] = 0
    bound += 10.0**-DIGITS  # scores are rounded
    floor, best = np.full(len(q), -np.inf), np.full((len(q), k), -np.inf)
    done = np.zeros(bound.shape, bool)
    found = []

    def score(g: int, who: np.ndarray) -> None:
        members = order[first[g] : upto[g]]
        strip = max(1, CELLS // len(members))
        for at in range(0, len(who), strip):
            some = who[at : at + strip]
            scores = np.round(q[some] @ c[members].T, DIGITS) + 0.0
            found.append(_top(scores, qids[some], ids[members], k, floor[some]))
            both = np.concatenate([best[some], scores], axis=1)
            best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
            floor[some] = best[some].min(axis=1)
        done[who, g] = True

    start = bound.argmax(axis=1)
    for g in range(len(names)):
        score(g, np.flatnonzero(start == g))
    for g in range(len(names)):
        score(g, np.flatnonzero((bound[:, g] >= floor) & ~done[:, g]))
    seen["pairs"] = seen.get("pairs", 0) + bound.size
    seen["scored"] = seen.get("scored", 0) + int(done.sum())
    return _best(pd.concat(found), k)


def _rank(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def _block_count(size: int, block_bytes: int) -> int:
    """Blocks of about ``block_bytes``; more than ``GRID_BLOCKS`` only where larger ones would pass ``BLOCK_BYTES``."""
    return max(1, min(-(-size // block_bytes), max(GRID_BLOCKS, -(-size // BLOCK_BYTES))))


def knn(
    queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", query_vec: str = "embedding",
    id: str = "id", vec: str = "embedding", where: Column | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exact top ``k`` by cosine: ``query_id, rank, id, score``.

    Both sides are written once as vectors and cut into blocks of about
    ``block_bytes``; a task holds one block of each and keeps the best ``k``
    per query, so pairs are never rows. Every block of a side meets every
    block of the other, so a side has no more than ``GRID_BLOCKS`` smaller than
    ``BLOCK_BYTES``: with blocks of one small size, cells and copies of rows
    would grow with the square of the input. Inside, groups of the corpus around
    pivots (a bounded sample of its vectors) are skipped where the triangle
    inequality rules them out. ``where`` filters the corpus before anything
    else.
    """
    corpus = corpus if where is None else corpus.where(where)
    corpus = cut_lineage(corpus.where(F.col(vec).isNotNull()).select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("vec")), "vectors")
    queries = cut_lineage(queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("vec")), "queries")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, score double"
    sample = corpus.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).toPandas()["vec"]
    if sample.empty:
        return _rank(corpus.sparkSession.createDataFrame([], schema), k)
    pivots = _unit(_matrix(sample))

    def blocks(df: DataFrame) -> int:
        return _block_count(df.agg(F.sum(8 * F.size("vec"))).first()[0] or 0, block_bytes)

    nq, nc = blocks(queries), blocks(corpus)
    # Blocks of a side that fit one task are still dealt over the cores.
    nc = max(nc, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", part("query_id", nq)).withColumn("cb", every(nc))
    right = corpus.withColumn("cb", part("id", nc)).withColumn("qb", every(nq))

    def cell(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        if lhs.empty or rhs.empty:
            return pd.DataFrame({"query_id": lhs["query_id"][:0], "id": rhs["id"][:0], "score": pd.Series([], dtype=float)})
        return search_block(
            lhs["query_id"].to_numpy(), _unit(_matrix(lhs["vec"])), rhs["id"].to_numpy(), _unit(_matrix(rhs["vec"])), pivots, k
        )

    grid = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(cell, schema)
    return _rank(grid, k)


# ---------------------------------------------------------------- keywords


def _postings(id_type: T.DataType):
    """Blocks of documents to one row a term: who holds it, how often, and how long each of them is.

    The row without a term has the block's number of documents and of terms.
    """
    arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lists = batch.column("terms")
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.append(0, np.cumsum(length))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, upto[at] + POSTING_TERMS, "right")) - 1)
                coded = pc.list_flatten(lists.slice(at, end - at)).dictionary_encode()
                codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
                rows = end - at
                keys, tf = np.unique(codes * rows + np.repeat(np.arange(rows), length[at:end]), return_counts=True)
                cuts = np.append(np.searchsorted(keys // rows, np.arange(len(names))), len(keys))
                who = keys % rows
                offsets = pa.array(np.append(cuts, len(keys)), pa.int32())  # one empty list more, for the row without a term
                ids = pa.ListArray.from_arrays(offsets, batch.column("id").slice(at, rows).take(pa.array(who)))
                tfs = pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))
                dls = pa.ListArray.from_arrays(offsets, pa.array(length[at:end][who], pa.int64()))
                terms = pa.concat_arrays([names.cast(pa.string()), pa.array([None], pa.string())])
                docs, total = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
                docs[-1], total[-1] = rows, int(length[at:end].sum())
                block = np.full(len(terms), task + n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), terms, ids.cast(pa.list_(arrow)), tfs, dls, pa.array(docs), pa.array(total)], ["block", "term", "ids", "tf", "dl", "docs", "total"]
                )
                at, n = end, n + 1

    return run


def bm25(
    queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", query: str = "query", id: str = "id",
    text: str = "text", k1: float = 1.2, b: float = 0.75, query_terms: int = QUERY_TERMS,
) -> DataFrame:
    """Top ``k`` by BM25: ``query_id, rank, id, score``.

    The corpus is read once: terms are counted inside a block of documents, and
    postings of terms that some query holds are written, one row a block and
    term. Queries are cut into blocks of about ``query_terms`` terms. The terms
    of both meet by an equi-join; a task goes through the blocks of documents
    that meet its block of queries, keeps the best ``k`` per query, and skips a
    query where the greatest shares of its terms in a block cannot reach its
    k-th best score. Pairs of queries and documents are never rows.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(tokens(F.col(query))).alias("terms"))
    asked = cut_lineage(asked.where(F.size("terms") > 0), "asked")
    parts = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // query_terms))
    by_term = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("qb"), "query_id", F.explode("terms").alias("term"))
    docs = corpus.select(F.col(id).alias("id"), tokens(F.col(text)).alias("terms"))
    kind = docs.schema["id"].dataType
    name = kind.simpleString()
    made = docs.mapInArrow(_postings(kind), f"block bigint, term string, ids array<{name}>, tf array<bigint>, dl array<bigint>, docs bigint, total bigint")
    # The row without a term rides along, whatever the queries hold.
    wanted = by_term.select("term").distinct().withColumn("known", F.lit(True))
    postings = cut_lineage(made.join(wanted, "term", "left").where(F.col("known") | F.col("term").isNull()).drop("known"), "postings")
    size = postings.where(F.col("term").isNull()).agg(F.struct(F.sum("docs").alias("n"), (F.sum("total") / F.sum("docs")).alias("avgdl")).alias("s")).scalar()
    held = postings.where(F.col("term").isNotNull()).select("block", "term", "ids", "tf", "dl")
    df = F.col("df")
    idf = held.groupBy("term").agg(F.sum(F.size("ids")).alias("df")).select(
        "term", F.ln(1 + (size["n"] - df + 0.5) / (df + 0.5)).alias("idf"), size["avgdl"].alias("avgdl")
    )
    share = F.zip_with("tf", "dl", lambda tf, dl: F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl"))))
    # Both sides have one row a term (and block), so a term that all hold makes no more rows than there are blocks.
    askers = by_term.groupBy("qb", "term").agg(F.collect_list("query_id").alias("askers"))
    met = held.join(idf, "term").select("block", "term", "ids", share.alias("share")).join(askers, "term").select("qb", "block", "ids", "share", "askers")
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {name}, score double"
    placed = met.repartition("qb", "block").sortWithinPartitions("qb", "block")
    return _rank(placed.mapInArrow(_score_postings(k), schema), k)


def _score_postings(k: int):
    """Rows of postings, block by block, to the best ``k`` documents of every query in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[object, list[tuple[float, object]]] = {}
        group, held, kinds = None, [], None

        def work() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = pc.list_flatten(rows["ids"]).combine_chunks().dictionary_encode()
            codes, names = ids.indices.to_numpy(zero_copy_only=False), ids.dictionary.to_pylist()
            shares = pc.list_flatten(rows["share"]).to_numpy()
            upto = np.append(0, np.cumsum(pc.list_value_length(rows["ids"]).to_numpy()))
            top = np.maximum.reduceat(shares, upto[:-1]) if len(shares) else np.zeros(0)
            terms: dict[object, list[int]] = {}
            for row, asking in enumerate(rows["askers"].to_pylist()):
                for q in asking:
                    terms.setdefault(q, []).append(row)
            for q, of in terms.items():
                mine = best.setdefault(q, [])
                if len(mine) == k and round(float(top[of].sum()) + 10.0**-DIGITS, DIGITS) < -mine[-1][0]:
                    continue
                cut = [slice(upto[r], upto[r + 1]) for r in of]
                at, back = np.unique(np.concatenate([codes[c] for c in cut]), return_inverse=True)
                total = np.round(np.bincount(back, weights=np.concatenate([shares[c] for c in cut])), DIGITS) + 0.0
                if k < len(total):
                    keep = total >= np.partition(total, len(total) - k)[len(total) - k]
                    at, total = at[keep], total[keep]
                best[q] = sorted([*mine, *((-float(s), names[i]) for i, s in zip(at, total, strict=True))])[:k]

        def hand_over() -> pa.RecordBatch:
            rows = [(q, i, -s) for q, found in best.items() for s, i in found]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["query_id", "id", "score"])

        for batch in batches:
            kinds = [batch.schema.field("askers").type.value_type, batch.schema.field("ids").type.value_type, pa.float64()]
            qb, block = batch.column("qb").to_numpy(), batch.column("block").to_numpy()
            edges = np.flatnonzero((qb[1:] != qb[:-1]) | (block[1:] != block[:-1])) + 1
            for lo, hi in zip(np.append(0, edges), np.append(edges, batch.num_rows), strict=True):
                if hi == lo:
                    continue
                here = (int(qb[lo]), int(block[lo]))
                if group is not None and here != group:
                    work()
                    held = []
                    if here[0] != group[0]:  # another block of queries
                        yield hand_over()
                        best.clear()
                group = here
                held.append(batch.slice(lo, hi - lo))
        if held:
            work()
            yield hand_over()

    return run


def hybrid_search(vector: DataFrame, keyword: DataFrame, k: int, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings of the same queries (give both more than ``k`` rows each)."""
    both = vector.select("query_id", "id", "rank").unionByName(keyword.select("query_id", "id", "rank"))
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (F.col("rank") + c)), 9).alias("score"))
    return _rank(fused, k)


# ---------------------------------------------------------------- after the ranking


def diversify(ranked: DataFrame, key: str, k: int) -> DataFrame:
    """Walk each query's rows in rank order, keep the first per ``key``, stop at ``k``; a null key is its own."""
    own = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("r"), F.col("rank").cast("string")))
    best = Window.partitionBy("query_id", own).orderBy("rank")
    kept = ranked.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1).drop("_n")
    again = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("_r", F.row_number().over(again)).where(F.col("_r") <= k).withColumn("rank", F.col("_r")).drop("_r")


def rerank(ranked: DataFrame, score: Column, k: int) -> DataFrame:
    """Score every candidate anew and keep the best ``k``; a query with a failed (null) score keeps its order."""
    per_query = Window.partitionBy("query_id")
    scored = ranked.withColumn("new_score", score.cast("double"))
    whole = F.min(F.col("new_score").isNotNull().cast("int")).over(per_query) == 1
    scored = scored.withColumn("_s", F.when(whole, F.col("new_score")))
    order = Window.partitionBy("query_id").orderBy(F.col("_s").desc_nulls_last(), "rank")
    out = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return out.withColumn("rank", F.col("_r")).drop("_s", "_r")


def build_context(queries: DataFrame, ranked: DataFrame, url: str = "url", text: str = "chunk_text") -> DataFrame:
    """``query_id, context``: the sources of each query in rank order, or a fixed sentence without any."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.coalesce(url, F.lit("")).alias("u"), F.coalesce(text, F.lit("")).alias("t"))))
    head, tail = SOURCE_HEAD.split("{}")
    line = lambda r, i: F.concat(F.lit(head), (i + 1).cast("string"), F.lit(tail), r["u"], F.lit("\n"), r["t"])
    made = ranked.groupBy("query_id").agg(F.array_join(F.transform(rows, line), SOURCE_GLUE).alias("_c"))
    joined = queries.select("query_id").join(made, "query_id", "left")
    return joined.select("query_id", F.coalesce("_c", F.lit(NO_SOURCE)).alias("context"))


def index_health(queries: DataFrame, ranked: DataFrame, keywords: list[str], text: str = "chunk_text") -> DataFrame:
    """Per query: results, whether all are long enough, the share that names the topic, and the verdict."""
    low = F.lower(F.col(text))
    about = F.lit(False)
    for w in keywords:
        about = about | F.contains(low, F.lit(w.lower()))
    made = ranked.groupBy("query_id").agg(
        F.count("*").alias("results"),
        F.min((F.coalesce(F.length(text), F.lit(0)) > 10).cast("int")).alias("_long"),
        F.avg(F.when(about, 1.0).otherwise(0.0)).alias("_share"),
    )
    out = queries.select("query_id").join(made, "query_id", "left").select(
        "query_id", F.coalesce("results", F.lit(0)).alias("results"),
        (F.coalesce("_long", F.lit(0)) == 1).alias("valid"), F.coalesce("_share", F.lit(0.0)).alias("relevance"),
    )
    return out.withColumn("healthy", (F.col("results") > 0) & F.col("valid") & (F.col("relevance") >= 0.6))


def result_overlap(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each given pair ``a, b`` of queries: shared results, and whether neither list holds the other."""
    sets = ranked.groupBy("query_id").agg(F.collect_set("id").alias("ids"))
    left = sets.select(F.col("query_id").alias("a"), F.col("ids").alias("_a"))
    right = sets.select(F.col("query_id").alias("b"), F.col("ids").alias("_b"))
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    empty = F.array().cast(sets.schema["ids"].dataType)
    xa, xb = F.coalesce("_a", empty), F.coalesce("_b", empty)
    shared = F.size(F.array_intersect(xa, xb))
    return both.select("a", "b", shared.alias("shared"), (shared < F.least(F.size(xa), F.size(xb))).alias("distinct_results"))


def citation_count(answers: DataFrame, ranked: DataFrame, answer: str = "answer", url: str = "url") -> DataFrame:
    """Per answer: retrieved addresses, and how many of them the answer names."""
    named = F.when((F.col(url) != "") & F.contains(F.col(answer), F.col(url)), 1).otherwise(0)
    joined = answers.select("query_id", answer).join(ranked.select("query_id", url), "query_id", "left")
    return joined.groupBy("query_id").agg(F.count(url).alias("retrieved"), F.sum(named).cast("bigint").alias("cited"))
