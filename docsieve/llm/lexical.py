"""Ranked lexical search: impact vectors in buckets of falling length, pruned by two bounds, rescored in whole numbers.

A document is the vector of its impacts on the terms that the items hold; an
item's score is the inner product with the item's counts. A task sorts its
vectors by length and goes through them bucket by bucket. Item length times the
bucket's greatest length bounds every score in it (Cauchy-Schwarz); the largest
value of each coordinate in the bucket bounds what terms can add, so a few
coordinates name the candidates; these are bounded once more by what they have
and the length of the rest, and the ones left are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm import segments as seg
from docsieve.session import cut_lineage

# Text of the items worked on at a time: bounds what every task holds of them.
ITEM_BYTES = 8 << 20
# Bytes of document text in one block of vectors; a longer text makes a longer block.
TASK_BYTES = 4 << 20
# Vectors in a bucket.
BUCKET = 1024
# Room for the rounding of the bounds, which are doubles.
SLACK = 1 + 1e-9
TOP = 20

# Bytes that end a term: all ASCII but digits and letters.
_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and each row's first of the terms of lower-cased bytes."""
    return seg.word_bounds(data, offsets, _BREAKS)


class Items:
    """The terms of a block of items: sorted hashes, a second hash each, and every item's terms with their counts."""

    def __init__(self, texts: pa.Array):
        data, offsets = seg.text_bytes(texts)
        data = seg.lower_ascii(data)
        starts, ends, firsts = terms(data, offsets)
        keys = seg.segment_hashes(data, starts, ends, 11)
        self.keys, at, place = np.unique(keys, return_index=True, return_inverse=True)
        second = seg.segment_hashes(data, starts, ends, 12)
        self.check = second[at]
        if (self.check[place] != second).any():
            raise ValueError("two terms of the items share a hash")
        self.terms, self.counts = [], []
        for i in range(len(firsts) - 1):
            ids, n = np.unique(place[firsts[i] : firsts[i + 1]], return_counts=True)
            self.terms.append(ids)
            self.counts.append(n.astype(np.int64))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms of the items, and which ones."""
        if not len(self.keys) or not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys = seg.segment_hashes(data, starts, ends, 11)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == keys)
        sure = self.check[place[hit]] == seg.segment_hashes(data, starts[hit], ends[hit], 12)
        hit = hit[sure]
        return hit, place[hit]


def _vectors(items):
    """Blocks of documents: ids, numbers of terms, and how often each term of the items occurs."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in seg.batches_of(batches, "text", TASK_BYTES):
            data, offsets = seg.text_bytes(b.column("text"))
            data = seg.lower_ascii(data)
            starts, ends, firsts = terms(data, offsets)
            n = np.diff(firsts)
            found, ids = items.value.find(data, starts, ends)
            row = np.searchsorted(firsts, found, "right") - 1
            width = max(1, len(items.value.keys))
            keys, tf = np.unique(row * width + ids, return_counts=True)
            col = b.column("id")
            doc = np.asarray(col.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            null = np.asarray(col.is_null().to_numpy(zero_copy_only=False), np.uint8)
            per = np.bincount(keys // width, minlength=b.num_rows)
            raw = [seg.planes(x) for x in (doc, null, n.astype(np.int64), per.astype(np.int64), (keys % width).astype(np.int32), tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r], pa.binary()) for r in raw], pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())],
                ["doc", "null", "n", "per", "ids", "tf", "docs", "terms"],
            )

    return work


_VECTORS = "doc binary, null binary, n binary, per binary, ids binary, tf binary, docs bigint, terms bigint"


def _holders(width: int):
    """How many documents of the task hold each term."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, np.int64)
        for b in batches:
            for raw in b.column("ids"):
                df += np.bincount(seg.from_planes(raw.as_py(), np.int32), minlength=width)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], ["id", "df"])

    return work


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Each document's m; in Python's whole numbers where 64 bits would not hold the product."""
    if len(n) and 25 * int(n.max()) * n_docs >= 1 << 62:
        return np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 75 + (25 * n * n_docs) // n_terms


class Best:
    """The highest-scoring documents of every item so far, equal scores by ascending id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.rows = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)) for _ in range(n_items)]
        # A score below the floor cannot enter; every score above 0 can until k are there.
        self.floor = np.ones(n_items, np.int64)

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        good = scores >= self.floor[item]
        if not good.any():
            return
        s, d, u = (np.concatenate([a, b[good]]) for a, b in zip(self.rows[item], (scores, docs, null), strict=True))
        order = np.lexsort((d, u, -s))[: self.k]
        self.rows[item] = (s[order], d[order], u[order])
        if len(order) == self.k:
            self.floor[item] = s[order[-1]]


def search_block(items: Items, weights: np.ndarray, n_docs: int, n_terms: int, block: dict[str, np.ndarray], best: Best, seen: dict[str, int]) -> None:
    """Score one block of vectors for every item; ``seen`` counts what the bounds left."""
    doc, null = block["doc"], block["null"]
    row = np.repeat(np.arange(len(doc)), block["per"])
    tf = block["tf"].astype(np.int64)
    m = _lengths(block["n"], n_docs, n_terms)
    value = weights[block["ids"]] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
    square = np.bincount(row, weights=value.astype(float) ** 2, minlength=len(doc))
    by_length = np.argsort(-square, kind="stable")
    by_length = by_length[: int((square > 0).sum())]
    place = np.full(len(doc), -1)
    place[by_length] = np.arange(len(by_length))
    square, doc, null = square[by_length], doc[by_length], null[by_length]
    entry = place[row]
    used = np.flatnonzero((entry >= 0) & (value > 0))
    width = len(weights)
    group = (entry[used] // BUCKET) * width + block["ids"][used]
    order = np.argsort(group, kind="stable")
    group, entry, value = group[order], entry[used][order], value[used][order]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    upto = np.append(first[1:], len(group))
    most = np.maximum.reduceat(value, first) if len(first) else np.empty(0, np.int64)
    keys = group[first]
    item_length = np.array([math.sqrt(float((c.astype(float) ** 2).sum())) for c in items.counts])
    at = np.full(width, -1)
    for b in range(-(-len(doc) // BUCKET)):
        lo, hi = b * BUCKET, min((b + 1) * BUCKET, len(doc))
        live = np.flatnonzero(item_length * math.sqrt(square[lo]) * SLACK >= best.floor)
        seen["buckets"] += len(items.terms)
        seen["buckets_left"] += len(live)
        g0, g1 = np.searchsorted(keys, [b * width, (b + 1) * width])
        here = keys[g0:g1] - b * width
        at[here] = np.arange(g0, g1)
        for q in live:
            floor = int(best.floor[q])
            g = at[items.terms[q]]
            known = g >= 0
            g, c = g[known], items.counts[q][known]
            bound = c * most[g]
            if int(bound.sum()) < floor:
                continue
            # The coordinates that can add least stay out, as long as they cannot reach the floor on their own.
            by_bound = np.argsort(bound, kind="stable")
            out = int(np.searchsorted(np.cumsum(bound[by_bound]), floor, "left"))
            rest, focus = by_bound[:out], by_bound[out:]
            pos, add, own = _entries(focus, g, c, first, upto, entry, value)
            size = hi - lo
            part = np.bincount(pos - lo, weights=add, minlength=size)
            if out:
                have = np.bincount(pos - lo, weights=own.astype(float) ** 2, minlength=size)
                length = math.sqrt(float((c[rest].astype(float) ** 2).sum()))
                more = np.minimum(float(bound[rest].sum()), length * np.sqrt(np.maximum(square[lo:hi] * SLACK - have, 0)))
                left = (part > 0) & ((part + more) * SLACK >= floor)
            else:
                left = part * SLACK >= floor
            seen["vectors"] += size
            seen["scored"] += int(left.sum())
            if not left.any():
                continue
            score = np.zeros(size, np.int64)
            pos, add, _ = _entries(np.arange(len(g)), g, c, first, upto, entry, value)
            mine = left[pos - lo]
            np.add.at(score, pos[mine] - lo, add[mine])
            who = np.flatnonzero(left)
            best.add(q, score[who], doc[lo:hi][who], null[lo:hi][who])
        at[here] = -1


def _entries(which, g, c, first, upto, entry, value) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, shares of the score and values of the entries of some coordinates."""
    cut = [slice(first[g[i]], upto[g[i]]) for i in which]
    if not cut:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    own = np.concatenate([value[s] for s in cut])
    times = np.repeat(c[which], [s.stop - s.start for s in cut])
    return np.concatenate([entry[s] for s in cut]), own * times, own


def blocks_of(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    kinds = {"doc": np.int64, "null": np.uint8, "n": np.int64, "per": np.int64, "ids": np.int32, "tf": np.int32}
    for i in range(batch.num_rows):
        yield {name: seg.from_planes(batch.column(name)[i].as_py(), kind) for name, kind in kinds.items()}


def _search(items, weights, n_docs: int, n_terms: int, k: int):
    """A task's best documents of every item."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = Best(len(items.value.terms), k), dict.fromkeys(("buckets", "buckets_left", "vectors", "scored"), 0)
        for b in batches:
            for block in blocks_of(b):
                search_block(items.value, weights.value, n_docs, n_terms, block, best, seen)
        for item, (scores, docs, null) in enumerate(best.rows):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), item), pa.int64()), pa.array(docs, pa.int64(), mask=null.astype(bool)), pa.array(scores)], ["item", "doc_id", "score"]
                )

    return work


def _item_blocks(items: DataFrame, item_id: str, text: str, item_bytes: int) -> list[DataFrame]:
    """The items in frames of about ``item_bytes`` of text each."""
    kept = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / item_bytes))
    if n == 1:
        return [kept]
    dealt = cut_lineage(kept.repartition(n).withColumn("block", F.spark_partition_id()), "items")
    return [dealt.where(F.col("block") == i).drop("block") for i in range(n)]


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` highest-scoring documents of every item; scores are whole numbers above 0.

    Null texts have no terms. Each row is a document or an item of its own:
    repeated rows of ``docs`` take a rank each, a repeated item is answered
    each time. Equal scores go by ascending ``doc_id`` (a whole number), null
    ids last. Other columns are left out, so their names cannot clash. Empty
    tables give no rows. Terms are compared by two 64-bit hashes.

    Items are worked off in blocks of about ``item_bytes`` of text; of one
    block a task holds the terms, their weights and ``k`` rows an item. For a
    block the documents are read once and leave vectors over the block's terms,
    which are written; they count holders of terms and are searched. Nothing
    but ``k`` rows per item and task is shuffled.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    found = []
    for frame in _item_blocks(items, item_id, item_text, item_bytes):
        rows = frame.toArrow()
        block = Items(rows.column("text"))
        names = spark.createDataFrame([(i, v) for i, v in enumerate(rows.column("item_id").to_pylist())], f"item bigint, item_id {kind}")
        shared = spark.sparkContext.broadcast(block)
        vectors = cut_lineage(corpus.mapInArrow(_vectors(shared), _VECTORS), "vectors")
        n_docs, n_terms = (int(x or 0) for x in vectors.agg(F.sum("docs"), F.sum("terms")).first())
        holders = vectors.select("ids").mapInArrow(_holders(len(block.keys)), "id bigint, df bigint").groupBy("id").agg(F.sum("df").alias("df")).toArrow()
        weights = np.zeros(max(1, len(block.keys)), np.int64)
        weights[holders.column("id").to_numpy()] = [weight(n_docs, df) for df in holders.column("df").to_pylist()]
        best = vectors.mapInArrow(_search(shared, spark.sparkContext.broadcast(weights), n_docs, max(1, n_terms), k), "item bigint, doc_id bigint, score bigint")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), len AS (
  SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
), all_ AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM len
), m AS (
  SELECT doc_id, 100 - 25 + ((25 * n * docs) // total) AS m FROM len, all_
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), all_
), s AS (
  SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM i JOIN tf ON tf.term = i.term JOIN w ON w.term = i.term JOIN m ON m.doc_id = tf.doc_id GROUP BY item_id, tf.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
