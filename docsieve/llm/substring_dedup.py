"""Passages that repeat: windows of words hashed, counted by hash, merged into removal spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm import segments as seg

# Bytes of text handled at a time in a task, and bytes of text per bucket of hashes.
TASK_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20
NULL_ID = np.iinfo(np.int64).min

_BLOCKS = "bucket int, found boolean, ids binary, counts binary, starts binary, hashes binary"
_SPANS = "id bigint, spans array<struct<start:int,end:int>>"


def _pack(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Entries in row order: the ids that have any, how many each has, and the steps between starts."""
    change = np.flatnonzero(np.diff(rows, prepend=-1))
    counts = np.diff(np.append(change, len(rows)))
    steps = np.diff(starts, prepend=0)
    steps[change] = starts[change]
    return [seg.planes(ids[rows[change]]), seg.planes(counts.astype(np.uint32)), seg.planes(steps.astype(np.uint32))]


def _unpack(ids: bytes, counts: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The id and the start of each entry."""
    c = seg.from_planes(counts, np.uint32).astype(np.int64)
    s = np.cumsum(seg.from_planes(starts, np.uint32).astype(np.int64))
    head = np.cumsum(c) - c
    before = np.where(head > 0, s[head - 1], 0)
    return np.repeat(seg.from_planes(ids, np.int64), c), s - np.repeat(before, c)


def _target(ids: np.ndarray, n: int) -> np.ndarray:
    return (seg.FAMILIES[11].mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _removed(ids: np.ndarray, starts: np.ndarray, n: int) -> Iterator[list]:
    """Windows to remove, one row for each bucket of documents."""
    to = _target(ids, n)
    order = np.lexsort((starts, ids, to))
    to, ids, starts = to[order], ids[order], starts[order]
    cuts = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = ids[a:b]
        rows = np.cumsum(np.diff(own, prepend=own[:1]) != 0)
        kept = own[np.flatnonzero(np.diff(rows, prepend=-1))]
        yield [int(to[a]), True, *_pack(kept, rows, starts[a:b]), None]


def _table(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_BLOCK_SCHEMA = pa.schema([
    ("bucket", pa.int32()), ("found", pa.bool_()), ("ids", pa.binary()), ("counts", pa.binary()), ("starts", pa.binary()), ("hashes", pa.binary()),
])


def _hash_blocks(size: int, n: int):
    """Hash every window of a block of documents.

    Of equal windows in the block only the first goes on to the bucket of its
    hash; the others are known to repeat and go to their document's bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in seg.batches_of(batches, "text", TASK_BYTES):
            ids = batch.column("id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            data, offsets = seg.text_bytes(batch.column("text"))
            begin, end, firsts = seg.word_bounds(data, offsets)
            words = seg.segment_hashes(data, begin, end, 11)
            key = seg.window_hashes(words, size, 11)
            if not len(key):
                continue
            bucket = (seg.window_hashes(words, size, 12) % np.uint64(n)).astype(np.int64)
            row = seg.rows_of(firsts).astype(np.int32)
            inside = row[: len(key)] == row[size - 1 :]
            row, key, bucket = row[: len(key)][inside], key[inside], bucket[inside]
            start = np.flatnonzero(inside) - firsts[row]
            place = np.lexsort((start, ids[row], key, bucket))
            b, k, r = bucket[place], key[place], row[place]
            new = np.ones(len(place), bool)
            new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
            # A repeated row of the same id is at the same place, and then not later.
            lead = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
            s = start[place]
            later = (ids[r] != ids[r[lead]]) | (s != s[lead])
            out = list(_removed(ids[r[later]], s[later], n))
            first = np.sort(place[new])
            first = first[np.argsort(bucket[first], kind="stable")]
            cuts = np.append(np.flatnonzero(np.diff(bucket[first], prepend=-1)), len(first))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                at = first[a:z]
                out.append([int(bucket[at[0]]), False, *_pack(ids, row[at], start[at]), key[at].tobytes()])
            for i in range(0, len(out), 64):
                yield _table(out[i : i + 64], _BLOCK_SCHEMA)

    return run


def _count(n: int):
    """In one bucket, find the windows whose words also start earlier elsewhere."""

    def run(group: pa.Table) -> pa.Table:
        known = [list(r.values()) for r in group.filter(group["found"]).to_pylist()]
        rows = group.filter(pa.compute.invert(group["found"])).to_pylist()
        if rows:
            parts = [_unpack(r["ids"], r["counts"], r["starts"]) for r in rows]
            ids, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
            # Most windows occur once; only the others are put in order of place.
            order = np.argsort(keys, kind="stable")
            sorted_keys = keys[order]
            same = sorted_keys[1:] == sorted_keys[:-1]
            several = np.append(same, False) | np.insert(same, 0, False)
            at = order[several]
            ids, starts, keys = ids[at], starts[at], keys[at]
            order = np.lexsort((starts, ids, keys))
            ids, starts, keys = ids[order], starts[order], keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else order
            later = (ids != ids[lead]) | (starts != starts[lead])
            known += _removed(ids[later], starts[later], n)
        return pa.Table.from_batches([_table(known, _BLOCK_SCHEMA)] if known else [], _BLOCK_SCHEMA)

    return run


_SPAN_SCHEMA = pa.schema([("id", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _merge(size: int):
    """Join the windows of each document into maximal spans."""

    def run(group: pa.Table) -> pa.Table:
        parts = [_unpack(r["ids"], r["counts"], r["starts"]) for r in group.to_pylist()]
        ids, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((starts, ids))
        ids, starts = ids[order], starts[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + size)
        at = np.flatnonzero(new)
        begin, end, own = starts[at], starts[np.append(at[1:], len(ids)) - 1] + size, ids[at]
        change = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        spans = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(change, len(own)), pa.int32()), spans)
        found = own[change]
        return pa.table([pa.array(found, pa.int64(), mask=found == NULL_ID), lists.cast(_SPAN_SCHEMA.field("spans").type)], schema=_SPAN_SCHEMA)

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 20, buckets: int | None = None) -> DataFrame:
    """Spans of words, by id, covered by a window of ``size`` words that also starts earlier.

    Earlier means a smaller id, or the same id and an earlier start. Returns
    ``id, spans`` for ids that have any; ends are exclusive and spans do not
    touch. Windows are compared by a 64-bit hash inside a bucket that a second,
    independent hash chooses; the number of buckets follows the text, so a
    false match stays unlikely at any size.

    Null or empty texts have no words. A null id sorts first. Repeated rows of
    one id and text are one document; rows of one id with other texts are
    compared by start. Other columns are not read.
    """
    spark = docs.sparkSession
    if buckets is None:
        total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    blocks = rows.mapInArrow(_hash_blocks(size, buckets), _BLOCKS)
    removed = blocks.groupBy("bucket").applyInArrow(_count(buckets), _BLOCKS)
    return removed.groupBy("bucket").applyInArrow(_merge(size), _SPANS)


def kept_words(text: str | bytes | None, spans) -> tuple[int, int, bytes]:
    """The number of words, of words in spans, and the other words joined by one space."""
    words = (text.encode() if isinstance(text, str) else text or b"").split()
    n, cut = len(words), 0
    for s in reversed(spans if spans is not None else []):
        cut += s["end"] - s["start"]
        del words[s["start"] : s["end"]]
    return n, cut, b" ".join(words)


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the column ``spans``; null where nothing is to be removed. A given column of that name is replaced."""
    other = spans.select(F.col("id").alias("_span_id"), F.col("spans").alias("spans"))
    return docs.drop("spans").join(other, docs[id_col].eqNullSafe(other["_span_id"]), "left").drop("_span_id")


def has_spans(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0
