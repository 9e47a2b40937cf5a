"""Lexical search against a plain scorer, and what the bounds leave."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docsieve.llm import lexical
from docsieve.llm import segments as seg

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=20):
    counts = [(i, Counter(words(t))) for i, t in docs]
    filled = [(i, c) for i, c in counts if c]
    n_docs, total = len(filled), sum(sum(c.values()) for _, c in filled)
    df = Counter(t for _, c in filled for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(words(text)), []
        for i, c in filled:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in asked.items() if t in c
            )
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def some_docs(rng, n, vocabulary):
    ranks = [1 / (r + 1) for r in range(len(vocabulary))]
    return [(i, rng.choice([" ", ", ", "_"]).join(rng.choices(vocabulary, ranks, k=rng.choice([0, 1, 3, 10, 40, 400])))) for i in range(n)]


VOCABULARY = [f"w{i}" for i in range(300)] + ["Éa", "éA", "ÀB", "x9", "X9", "日本", "a1b"]


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(2)
    docs = some_docs(rng, 700, VOCABULARY)
    docs += [(None, "w1 w2 x9"), (None, None), (5000, None), (5001, ""), (5002, "... --"), (3, docs[3][1]), (3, docs[3][1]), (-7, docs[3][1]), (5003, " ".join(VOCABULARY * 300))]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=rng.choice([1, 2, 8, 30])))) for i in range(40)]
    items += [(None, "w5 w5 w5 x9"), (100, None), (101, ""), (102, "nowhere tobefound"), (7, items[7][1]), (103, "éA"), (104, "w0")]
    return docs, items


@pytest.mark.parametrize("item_bytes", [lexical.ITEM_BYTES, 400])
def test_against_brute_force(spark, tables, item_bytes):
    docs, items = tables
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id bigint, text string, item_id string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string")
    got = lexical.search(d, q, item_bytes=item_bytes)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark, tables):
    docs, items = tables
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert lexical.search(d.limit(0), q).count() == 0
    assert lexical.search(d, q.limit(0)).count() == 0
    assert lexical.search(d.where("text is null"), q).count() == 0


def test_bounds_leave_out_most(monkeypatch):
    """Many small buckets: both bounds cut work, and the result stays exact."""
    monkeypatch.setattr(lexical, "BUCKET", 32)
    rng = random.Random(6)
    docs = some_docs(rng, 3000, VOCABULARY)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=4))) for i in range(30)]
    block = lexical.Items(pa.array([t for _, t in items]))
    data, offsets = seg.text_bytes(pa.array([t for _, t in docs]))
    data = seg.lower_ascii(data)
    starts, ends, firsts = lexical.terms(data, offsets)
    found, ids = block.find(data, starts, ends)
    width = len(block.keys)
    keys, tf = np.unique((np.searchsorted(firsts, found, "right") - 1) * width + ids, return_counts=True)
    n = np.diff(firsts)
    n_docs, total = int((n > 0).sum()), int(n.sum())
    weights = np.array([lexical.weight(n_docs, df) for df in np.bincount(keys % width, minlength=width)])
    vectors = {
        "doc": np.arange(len(docs)), "null": np.zeros(len(docs), np.uint8), "n": n, "per": np.bincount(keys // width, minlength=len(docs)),
        "ids": (keys % width).astype(np.int32), "tf": tf.astype(np.int32),
    }
    best, seen = lexical.Best(len(items), 5), Counter()
    lexical.search_block(block, weights, n_docs, total, vectors, best, seen)
    got = [(items[q][0], r + 1, int(d), int(s)) for q, (ss, ds, _) in enumerate(best.rows) for r, (s, d) in enumerate(zip(ss, ds, strict=True))]
    assert sorted(got, key=str) == brute(docs, items, 5)
    pairs = len(docs) * len(items)
    assert seen["buckets_left"] < 0.7 * seen["buckets"]  # lengths alone
    assert seen["vectors"] < 0.4 * pairs  # and the greatest coordinates of a bucket
    assert seen["scored"] < 0.1 * pairs
