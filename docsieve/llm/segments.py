"""Hashes of words, lines and windows over whole Arrow batches, in numpy.

A segment's hash is a polynomial over its bytes modulo 2^64 with a random
64-bit value per byte, taken from one running sum per block (Rabin-Karp), so
the cost is per byte of text and not per segment.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
# Bytes hashed at a time; a longer segment makes a longer block.
BLOCK = 1 << 19


def _odd_inverse(a: int) -> int:
    """The inverse of an odd number modulo 2^64."""
    return pow(a, -1, 1 << 64)


class Family:
    """One hash function: values for bytes, a multiplier and its powers."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        draw = rng.integers(0, 1 << 63, 260, dtype=np.int64).view(U64)
        self.bytes = draw[:256] * U64(2) + U64(1)
        self.base = int(draw[256]) | 5
        self.k = [U64(int(v) | 1) for v in draw[257:260]]
        self.pow = self.inv = np.ones(1, U64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pow) < n:
            size = max(n, 2 * len(self.pow))
            for name, b in (("pow", self.base), ("inv", _odd_inverse(self.base))):
                steps = np.full(size, U64(b))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.pow, self.inv

    def mix(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> U64(32))) * self.k[0]
        h = (h ^ (h >> U64(29))) * self.k[1]
        return h ^ (h >> U64(32))


FAMILIES = {seed: Family(seed) for seed in (11, 12)}


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each row starts (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give memory that is free back to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc: nothing to trim


def batches_of(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Record batches joined or cut until each holds about ``most`` bytes of ``text``, or one row."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            room = max(most - size, 0)
            upto = int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1
            if upto <= at and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
                continue
            upto = max(upto, at + 1)
            held.append(batch.slice(at, upto - at))
            size += int(offsets[upto] - offsets[at])
            at = upto
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held = []
    release()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without bytes of ``breaks``; ``[^\\x20\\x09-\\x0D]+``), and each row's first word (one more at the end)."""
    solid = ~breaks[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(solid[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    inner = offsets[1:-1]
    last[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(solid & first)
    ends = np.flatnonzero(solid & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each segment's bytes; segments are in order and do not overlap."""
    fam = FAMILIES[seed]
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        n = int(ends[upto - 1] - base)
        powers, inverse = fam.powers(n)
        sums = np.zeros(n + 1, U64)
        np.cumsum(fam.bytes[data[base : base + n]] * powers[:n], out=sums[1:])
        s, e = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * fam.k[2]
        at = upto
    return fam.mix(out)


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The hash of every run of ``size`` words, from running sums over blocks of them."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    fam = FAMILIES[seed]
    out = np.empty(n, U64)
    for at in range(0, n, BLOCK // 4):
        upto = min(n, at + BLOCK // 4)
        m = upto - at + size - 1
        powers, inverse = fam.powers(m)
        sums = np.zeros(m + 1, U64)
        np.cumsum(words[at : at + m] * powers[:m], out=sums[1:])
        out[at:upto] = (sums[size:] - sums[:-size]) * inverse[: upto - at]
    return fam.mix(out)


def rows_of(firsts: np.ndarray) -> np.ndarray:
    """The row of each item, from each row's first item."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, so that the shuffle's compression drops the empty high bytes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not raw:
        return np.empty(0, kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()
