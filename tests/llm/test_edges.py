"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for operators 1, 3, 4, 5, 7, 9 and 10."""

import hashlib
import tracemalloc
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsieve.llm import exact_dedup, jaccard_join, line_dedup, mixing, packing, quality, substring_dedup

PASSAGE = " ".join(f"w{i}" for i in range(30))
LINE = "A line that Many documents share "
ROWS = [
    (1, None, "a"), (2, "", None), (3, "x " + PASSAGE + f" y\n{LINE}", "b"), (4, "z\t" + PASSAGE + f"\n {LINE.upper()}\nown", "b"),
    (5, f"{LINE}\n{LINE}\nlast", None), (5, f"{LINE}\n{LINE}\nlast", None), (None, PASSAGE, "a"), (6, " ".join(str(i) for i in range(30_000)), "a"), (7, PASSAGE, "a"),
]
SCHEMA = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns with names that the operators use themselves.
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("id", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("_keep", F.lit(2))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_spans(docs, none):
    got = {r.id: [tuple(s) for s in r.spans] for r in substring_dedup.repeated_spans(docs.select("doc_id", "text")).collect()}
    assert got == {3: [(1, 31)], 4: [(1, 31)], 7: [(0, 30)]}  # the null id comes first and keeps the passage
    assert substring_dedup.repeated_spans(none).count() == 0


def test_lines(docs, none):
    maps = line_dedup.keep_bitmaps(docs).collect()
    assert {(r.id, r.n_lines, r.n_dropped) for r in maps} == {(3, 2, 1), (4, 3, 1)}
    assert line_dedup.keep_bitmaps(none).count() == 0


def test_exact(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    norm = Counter("".join(brute.WORD.findall(t or "")) for _, t, _ in ROWS)
    for r in got:
        text = next("".join(brute.WORD.findall(t or "")) for i, t, _ in ROWS if i == r.doc_id)
        assert r.group_size == norm[text] and r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sum(r.kept for r in got) == len(norm)
    assert {r.keep_id for r in got if r.doc_id in (None, 7)} == {7}
    assert exact_dedup.exact_groups(none).count() == 0


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    total = sum(len(brute.WORD.findall(t or "")) for _, t, _ in ROWS)
    targets = {r.source: (r.target, r.source_size) for r in got}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    for source, (target, size) in targets.items():
        assert target <= 2 * size
        assert sum(r.taken for r in got if r.source == source) == int(target)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix(none).count() == 0
    assert mixing.repeat_taken(docs).columns == docs.columns


def test_near(docs, none):
    got = {(r.id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs).collect()}
    want = brute.near_components([(i, t) for i, t, _ in ROWS if i is not None])
    assert {(i, n, c) for i, n, c in got if i is not None} == {(i, n, c) for i, (n, c) in want.items()}
    assert (None, 27, None) in got
    assert jaccard_join.similar_groups(none).count() == 0


def test_pack(docs, none):
    got = packing.pack_documents(docs, capacity=256).collect()
    assert {r.doc_id for r in got} == {r[0] for r in ROWS}
    assert sum(r.piece == 0 for r in got) == len(ROWS)
    assert max(r.length for r in got) == 256 and max(r.offset + r.length for r in got) <= 256
    assert packing.pack_documents(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (5, None), (None, 1), (6, 7)], "doc_id bigint, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(none, labels).count() == 0


def test_local_search_packs_no_worse():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(5):
        sizes = rng.integers(60, 140, 300)
        start = np.arange(300) // 2  # a poor start: two items a bin
        fill = np.bincount(start, weights=sizes)
        end = packing.local_search(sizes, start, 300)
        after = np.bincount(end, weights=sizes)
        assert after.max() <= 300 and (after**2).sum() >= (fill**2).sum() and len(after) < len(fill)


def test_packing_holds_little_at_a_time():
    rng = np.random.default_rng(2)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefgh"), (3000, 4))])
    texts = [" ".join(rng.choice(words, 400)) for _ in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    run = packing._pieces(packing.default_vocabulary(), 2048)
    assert sum(b.num_rows for b in run(iter([batch.slice(0, 100)]))) == 100  # the vocabulary is loaded
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= len(texts) and peak < 60e6


def test_quality_takes_little_memory_at_a_time():
    rng = np.random.default_rng(3)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefgh"), (3000, 4))])
    texts = [" ".join(rng.choice(words, 400)) for _ in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    model = quality.Model(np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    tracemalloc.start()
    kept = sum(b.num_rows for b in quality._keep(model, "text")(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept == len(texts) and peak < 80e6
