"""The pipeline's stages against plain Python on the smallest tables."""

import math
from collections import defaultdict

import brute
import pytest

import corpus_pipeline
from docsieve.session import cut_lineage


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], sf), name))
    return [[r.asDict() for r in df.collect()] for df in out], docs.columns


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_columns(stages):
    rows, columns = stages
    for r in rows[1:5]:
        assert list(r[0]) == columns


def test_poor_documents_go(spark, sf, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = texts(stages[0][0]), texts(stages[0][1])
    assert all(before[i] == t for i, t in after.items())
    wrong = [i for i, q in labels.items() if i in before and (i in after) != (q == 1)]
    assert len(wrong) <= 0.05 * len(labels)


def test_lines(stages):
    before, after = texts(stages[0][1]), texts(stages[0][2])
    found = defaultdict(set)
    key = lambda x: x.strip("\x20\t\n\x0b\x0c\r").translate(brute.FOLD)
    for i, t in before.items():
        for line in (t or "").split("\n"):
            found[key(line)].add(i)
    gone = {k: max(ids) for k, ids in found.items() if len(k) >= 20 and len(ids) >= 3}
    want = {i: "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i) for i, t in before.items()}
    assert after == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages[0][2])


def test_near_copies(stages):
    before, after = texts(stages[0][2]), texts(stages[0][3])
    groups = brute.near_components(list(before.items()), size=5, threshold=80)
    assert set(after) == {i for i, (_, c) in groups.items() if c == i}


def test_mix(stages):
    before, after = stages[0][3], stages[0][4]
    size = {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in before}
    taken = defaultdict(int)
    for r in after:
        taken[r["doc_id"]] += 1
    assert max(taken.values()) <= 2 and set(taken) <= set(size)
    words = sum(size[i] * n for i, n in taken.items())
    assert words == pytest.approx(1.5 * sum(size.values()), rel=0.1)


def test_pack(stages):
    pieces, docs = stages[0][5], stages[0][4]
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(p["piece"] == 0 for p in pieces) == len(docs)
    assert len(by) <= 1.02 * math.ceil(sum(p["length"] for p in pieces) / 2048) + 1
