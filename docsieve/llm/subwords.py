"""Subword ids of whole Arrow batches: every distinct word goes through the tokenizer once per worker."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from docsieve.llm import segments as seg

# Words a worker remembers.
REMEMBER = 500_000
# Words that go through the tokenizer at a time.
LEARN = 2_000
_loaded: dict[str, Subwords] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Subwords:
    """The ids of words, found by a 64-bit hash of their bytes.

    The tokenizer cuts at white space and looks at nothing beyond it, so a
    text's ids are its words' ids in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.places = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int32)
        self.ids = np.empty(0, np.int32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Remember new words; ``keys`` are sorted."""
        if len(self.keys) > REMEMBER:
            self.forget()
        got, sizes = [], []
        for i in range(0, len(words), LEARN):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[i : i + LEARN], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int32, len(found)))
            got.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes[-1].sum())))
        lengths = np.concatenate(sizes)
        places = len(self.ids) + np.cumsum(lengths, dtype=np.int64) - lengths
        self.ids = np.concatenate([self.ids, *got])
        # Both sides are sorted: the new ones go between the old.
        at = np.searchsorted(self.keys, keys) + np.arange(len(keys))
        old = np.ones(len(self.keys) + len(keys), bool)
        old[at] = False
        for name, own in (("keys", keys), ("places", places), ("lengths", lengths)):
            merged = np.empty(len(old), own.dtype)
            merged[old] = getattr(self, name)
            merged[at] = own
            setattr(self, name, merged)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of every word, and all ids in a row."""
        # The tokenizer lower-cases, but for its special words.
        special = b"<|" in data.tobytes()
        keys = seg.segment_hashes(data if special else seg.lower_ascii(data), starts, ends, 11)
        if special:
            keys = keys ^ np.uint64(1 << 63)
        uniq, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == uniq[known]
        if not known.all():
            if len(self.keys) > REMEMBER:
                self.forget()
                known[:] = False
            new = np.flatnonzero(~known)
            text = data.tobytes()
            self._learn(uniq[new], [text[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new]])
            at = np.searchsorted(self.keys, uniq)
        counts, places = self.lengths[at][back], self.places[at][back]
        before = np.cumsum(counts, dtype=np.int64) - counts
        return counts, self.ids[np.repeat(places - before, counts) + np.arange(int(counts.sum()))]

    def documents(self, col: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each row closed by ``end``, and where each row starts (one more at the end)."""
        data, offsets = seg.text_bytes(col)
        starts, ends, firsts = seg.word_bounds(data, offsets)
        counts, ids = self.words(data, starts, ends) if len(starts) else (np.empty(0, np.int32), np.empty(0, np.int32))
        upto = np.append(0, np.cumsum(counts, dtype=np.int64))[firsts]
        lengths = np.diff(upto)
        out = np.full(len(ids) + len(lengths), end, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
        return out, upto + np.arange(len(upto))


def subwords(path: str) -> Subwords:
    if path not in _loaded:
        _loaded[path] = Subwords(path)
    return _loaded[path]
