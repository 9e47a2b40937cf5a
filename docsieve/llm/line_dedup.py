"""Repeated lines: hashes range-partitioned and sorted by document and place, decided in one stream."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm import segments as seg
from docsieve.session import cut_lineage

TASK_BYTES = 8 << 20
MIN_CHARS = 20
MIN_DOCS = 3
NULL_ID = np.iinfo(np.int64).min

_LINE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("fp", pa.int64()), ("n_lines", pa.int32()), ("pos", pa.int32())])
_LINES = "h1 bigint, h2 bigint, id bigint, fp bigint, n_lines int, pos int"
_FOUND = pa.schema([*_LINE, ("open", pa.bool_()), ("seen", pa.list_(pa.int64()))])
_STREAM = f"{_LINES}, open boolean, seen array<bigint>"


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines cut at ``\\n``, and each row's first line; an empty row has one line."""
    breaks = np.flatnonzero(data == 10)
    # A row's lines start at its start and after each of its breaks; they end at each break and at the row's end.
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    counts = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return starts, ends, np.append(0, np.cumsum(counts))


def _stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = np.flatnonzero(~seg._SPACE[data])
    if not len(solid):
        return starts, starts
    a = np.searchsorted(solid, starts)
    b = np.searchsorted(solid, ends)
    some = b > a
    at = np.minimum(a, len(solid) - 1)
    return np.where(some, solid[at], starts), np.where(some, solid[np.maximum(b, 1) - 1] + 1, starts)


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in seg.batches_of(batches, "text", TASK_BYTES):
            data, offsets = seg.text_bytes(batch.column("text"))
            starts, ends, firsts = line_bounds(data, offsets)
            row = seg.rows_of(firsts)
            a, b = _stripped(data, starts, ends)
            chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            use = np.flatnonzero(chars[b] - chars[a] >= min_chars)
            low = seg.lower_ascii(data)
            hashes = [seg.segment_hashes(low, a[use], b[use], seed).view(np.int64) for seed in (11, 12)]
            r = row[use]
            ids = batch.column("id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            cols = [*hashes, ids[r], fps[r], np.diff(firsts)[r].astype(np.int32), (use - firsts[r]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_LINE)

    return run


def _stream(min_docs: int):
    """Sorted lines of one range: the largest id comes first and keeps its lines, later ids lose theirs.

    A group is decided once the range goes on to the next. The first and the
    last group of a range may continue in other ranges: their rows go out open,
    with the first ids seen here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True

        def decide(t: dict, at_end: bool) -> pa.RecordBatch:
            nonlocal first
            h1, h2, ids = t["h1"], t["h2"], t["id"]
            n = len(h1)
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            group = np.cumsum(new) - 1
            other = new.copy()
            other[1:] |= ids[1:] != ids[:-1]
            docs = np.bincount(group[other], minlength=group[-1] + 1)
            open_ = np.zeros(group[-1] + 1, bool)
            open_[0], open_[-1] = first, at_end
            first = False
            drop = (docs[group] >= min_docs) & (ids != ids[np.flatnonzero(new)][group]) & ~open_[group]
            out = drop | open_[group]
            seen = [None] * n
            for g in np.flatnonzero(open_):
                at = np.flatnonzero((group == g) & other)
                seen[np.flatnonzero(group == g)[0]] = ids[at[:min_docs]].tolist()
            idx = np.flatnonzero(out)
            cols = [t[f.name][idx] for f in _LINE]
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c) for c in cols], pa.array(open_[group[idx]]), pa.array([seen[i] for i in idx], pa.list_(pa.int64()))], schema=_FOUND
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            t = {f.name: batch.column(f.name).to_numpy(zero_copy_only=False) for f in _LINE}
            if held is not None:
                t = {k: np.concatenate([held[k], v]) for k, v in t.items()}
            change = np.flatnonzero((np.diff(t["h1"]) != 0) | (np.diff(t["h2"]) != 0))
            cut = change[-1] + 1 if len(change) else 0
            if cut:
                yield decide({k: v[:cut] for k, v in t.items()}, False)
            held = {k: v[cut:] for k, v in t.items()}
        if held is not None:
            yield decide(held, True)

    return run


def _bitmaps(pdf):
    """One compressed bitmap per document, a set bit for every line that stays."""
    import pandas as pd

    rows = []
    for (i, fp), g in pdf.groupby(["id", "fp"], sort=False):
        keep = np.ones(int(g["n_lines"].iloc[0]), np.uint8)
        keep[g["pos"].to_numpy()] = 0
        rows.append((i, fp, len(keep), len(keep) - int(keep.sum()), zlib.compress(np.packbits(keep).tobytes())))
    return pd.DataFrame(rows, columns=["id", "fp", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``id, fp, n_lines, n_dropped, keep`` of each document that loses lines; all other documents keep all.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z
    lower-cased. Keys of at least ``min_chars`` code points that occur in
    ``min_docs`` documents stay in the largest id only. ``keep`` is a
    zlib-compressed bitmap, first line first.

    Rows of one id are one document when documents are counted; ``fp``, a hash
    of the text, tells them apart otherwise. A null id is the smallest. Null
    and empty texts are one empty line. Keys are compared by 128 bits of hash.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))
    lines = cut_lineage(rows.mapInArrow(_hash_lines(min_chars), _LINES), "lines")
    order = [F.col("h1"), F.col("h2"), F.col("id").desc(), F.col("pos"), F.col("fp")]
    ranged = lines.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = cut_lineage(ranged.mapInArrow(_stream(min_docs), _STREAM), "found")
    # At most two open groups per range, each with a few ids.
    edges = found.where("seen is not null").groupBy("h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("ids"))
    edges = edges.where(F.size("ids") >= min_docs).select("h1", "h2", F.array_max("ids").alias("stays"))
    late = found.where("open").join(edges, ["h1", "h2"]).where(F.col("id") != F.col("stays"))
    cols = ["id", "fp", "n_lines", "pos"]
    drops = found.where(~F.col("open")).select(*cols).union(late.select(*cols)).distinct()
    # A document's drops meet in one task: no more than its own lines.
    parts = F.pmod(F.xxhash64("id", "fp"), F.lit(4 * n)).alias("_part")
    maps = drops.groupBy(parts).applyInPandas(_bitmaps, "id bigint, fp bigint, n_lines int, n_dropped int, keep binary")
    return maps.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id")))


def kept_lines(text: str | None, keep: bytes | None) -> tuple[int, int, str]:
    """The number of lines, of dropped lines, and the lines that stay."""
    lines = (text or "").split("\n")
    if keep is None:
        return len(lines), 0, text or ""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    stay = [x for x, k in zip(lines, bits, strict=True) if k]
    return len(lines), len(lines) - len(stay), "\n".join(stay)


def with_bitmaps(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_keep``, null for documents that keep all lines."""
    own = docs.withColumn("_fp", F.xxhash64(text_col))
    other = maps.select(F.col("id").alias("_id"), F.col("fp").alias("_ofp"), F.col("keep").alias("_keep"))
    on = own[id_col].eqNullSafe(other["_id"]) & (own["_fp"] == other["_ofp"])
    return own.join(other, on, "left").drop("_id", "_ofp", "_fp")


def _cut_lines(names: list[str]):
    """The columns by their places, named again; the last one is the bitmap."""
    text, n_chars = names.index("text"), names.index("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in seg.batches_of(batches, f"c{text}", TASK_BYTES):
            cols = list(batch.columns)
            texts, sizes = cols[text].to_pylist(), cols[n_chars].to_pylist()
            for i, keep in enumerate(cols.pop().to_pylist()):
                if keep is not None:
                    texts[i] = kept_lines(texts[i], keep)[2]
                    sizes[i] = len(texts[i])
            cols[text] = pa.array(texts, cols[text].type)
            cols[n_chars] = pa.array(sizes, cols[n_chars].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def without_lines(docs: DataFrame) -> DataFrame:
    """Documents (``doc_id, text, n_chars`` and others) without the lines that ``keep_bitmaps`` drops.

    Null texts and rows without an id stay as ``keep_bitmaps`` has them; other
    columns ride along under any name.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (f"c{docs.columns.index(n)}" for n in ("doc_id", "text"))
    marked = with_bitmaps(plain, keep_bitmaps(plain, doc_id, text), doc_id, text)
    return marked.mapInArrow(_cut_lines(docs.columns), docs.schema)
