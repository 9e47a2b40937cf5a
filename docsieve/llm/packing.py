"""Packing documents into sequences of tokens: best fit, then a local search that empties bins by swaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm import segments as seg
from docsieve.llm.subwords import default_vocabulary, subwords
from docsieve.session import cut_lineage

TASK_BYTES = 1 << 20
CAPACITY = 2048
# Pieces packed together in one task; each such group leaves at most a few bins partly filled.
GROUP_PIECES = 32_768

_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker that is used again still holds what earlier stages have freed.
        seg.release()
        coder = subwords(vocabulary)
        for batch in seg.batches_of(batches, "text", TASK_BYTES):
            ids, firsts = coder.documents(batch.column("text"), 0)
            sizes = np.diff(firsts)
            counts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = (firsts[row] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``doc_id, piece, start, length, ids_crc32``.

    A document's tokens are its subword ids and a closing 0, so an empty or
    null text has one token. Only longer documents are cut. Rows stand for
    themselves: repeated rows and null ids are packed like any other.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(vocabulary or default_vocabulary(), capacity), _PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for every item: largest items first, each into the fullest bin that has room."""
    bins = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            b, room = count, capacity
            count += 1
        bins[i] = b
        left = room - s
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empty bins by moves and swaps between underfull bins, each of which increases the squared fill.

    The lightest underfull bin gives: an item moves to a fuller bin, or is
    exchanged for a smaller one there, or two items are exchanged for one. The
    step with the largest gain is taken. A bin that has no such step rests. The
    squared fill is a whole number with a bound, so this ends by itself: when
    no bin has a step, or no fewer bins can hold the items.
    """
    bins = bins.copy()
    n_bins = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, weights=sizes, minlength=n_bins).astype(np.int64)
    least = -(-int(sizes.sum()) // capacity)
    rest, moved = np.zeros(n_bins, bool), False
    used = int((fill > 0).sum())
    items = np.flatnonzero(fill[bins] < capacity)
    while used > least:
        open_ = (fill > 0) & (fill < capacity)
        lightest = np.where(open_ & ~rest, fill, capacity + 1)
        b = int(lightest.argmin()) if n_bins else 0
        if not n_bins or lightest[b] > capacity:
            if not moved:
                break
            # Other bins have changed since some came to rest.
            rest[:], moved = False, False
            continue
        own = items[bins[items] == b]
        others = items[(bins[items] != b) & open_[bins[items]] & (fill[bins[items]] >= fill[b])]
        step = _best_step(sizes, bins, fill, b, own, others, open_, capacity)
        if step is None:
            rest[b] = True
            continue
        give, take, to = step
        for i in give:
            bins[i] = to
        if take is not None:
            bins[take] = b
        d = int(sizes[list(give)].sum()) - (int(sizes[take]) if take is not None else 0)
        fill[b] -= d
        fill[to] += d
        used -= int(fill[b] == 0)
        rest[b] = rest[to] = False
        moved = True
    names = np.unique(bins, return_inverse=True)[1]
    return names


def _best_step(sizes, bins, fill, b, own, others, open_, capacity):
    """The items to give, the item to take (or none) and the other bin, with the largest gain in squared fill."""
    best, found = 0, None
    targets = np.flatnonzero(open_ & (np.arange(len(fill)) != b) & (fill >= fill[b]))
    singles = own[np.unique(sizes[own], return_index=True)[1]]
    for a in singles[::-1]:
        s = int(sizes[a])
        ok = targets[fill[targets] + s <= capacity]
        if len(ok):
            to = int(ok[fill[ok].argmax()])
            gain = s * (fill[to] - fill[b] + s)
            if gain > best:
                best, found = gain, ((int(a),), None, to)
    if found is not None or not len(others):
        return found
    free = capacity - fill[bins[others]]
    pairs = [((int(a),), int(sizes[a])) for a in singles]
    # Distinct sizes in one bin are few: their sum is at most the capacity. Two items of one size are a pair as well.
    pairs += [((int(x), int(y)), int(sizes[x] + sizes[y])) for i, x in enumerate(singles) for y in singles[i + 1 :]]
    for x in singles:
        twin = own[(sizes[own] == sizes[x]) & (own != x)]
        if len(twin):
            pairs.append(((int(x), int(twin[0])), 2 * int(sizes[x])))
    for give, s in pairs:
        d = s - sizes[others]
        ok = (d > 0) & (d <= free)
        if ok.any():
            gain = np.where(ok, d * (fill[bins[others]] - fill[b] + d), 0)
            at = int(gain.argmax())
            if gain[at] > best:
                best, found = int(gain[at]), (give, int(others[at]), int(bins[others[at]]))
    return found


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """A bin and the place in it for every item; items in a bin leave no gap."""
    sizes = np.asarray(sizes, np.int64)
    bins = local_search(sizes, best_fit(sizes, capacity), capacity)
    order = np.argsort(bins, kind="stable")
    upto = np.cumsum(sizes[order])
    head = np.append(True, np.diff(bins[order]) != 0) if len(order) else np.empty(0, bool)
    base = np.maximum.accumulate(np.where(head, upto - sizes[order], 0)) if len(order) else upto
    offset = np.empty(len(sizes), np.int64)
    offset[order] = upto - sizes[order] - base
    return bins, offset


def _pack_group(capacity: int):
    def run(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offset = pack(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = (pdf["group"].to_numpy().astype(np.int64) << 32) + bins
        pdf["offset"] = offset
        return pdf.drop(columns="group")

    return run


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """``token_pieces`` with ``sequence_id`` and ``offset``, the place in the sequence.

    Pieces, not texts, are shuffled, into groups of about ``group_pieces`` by a
    hash of all their columns and a random-looking spread of repeated rows;
    each group is packed in one task.
    """
    pieces = token_pieces(docs, id_col, text_col, vocabulary, capacity).withColumn("_row", F.monotonically_increasing_id())
    pieces = cut_lineage(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("_row"), F.lit(groups)).cast("int")).drop("_row")
    return grouped.groupBy("group").applyInPandas(_pack_group(capacity), f"{_PIECE}, sequence_id bigint, offset bigint")
