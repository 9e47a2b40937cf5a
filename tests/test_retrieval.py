import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.operators import retrieval as rt


def brute_knn(queries, corpus, k):
    out = {}
    for q, qv in queries:
        scored = []
        for i, v in corpus:
            n = np.linalg.norm(qv) * np.linalg.norm(v)
            scored.append((-(round(float(np.dot(qv, v) / n), 6) if n else 0.0), i))
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("block_bytes, pivots", [(32 << 20, 64), (200, 3), (50, 1)])
def test_knn_equals_brute_force(spark, monkeypatch, block_bytes, pivots):
    monkeypatch.setattr(rt, "PIVOTS", pivots)
    rng = np.random.default_rng(5)
    base = rng.integers(-3, 4, size=(40, 6)).astype(float)
    # A third of the corpus is one and the same vector, some are zero.
    corpus = [(i, base[i % 40] if i % 3 else base[0]) for i in range(60)] + [(60, np.zeros(6))]
    queries = [(i, rng.normal(size=6)) for i in range(7)] + [(7, base[0])]
    cdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in corpus], "id long, embedding array<double>").repartition(5)
    qdf = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries], "query_id long, embedding array<double>")
    got = {}
    for r in rt.knn(qdf, cdf, 5, block_bytes=block_bytes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == brute_knn(queries, corpus, 5)


def test_small_blocks_do_not_make_a_grid_with_the_square_of_the_input():
    cells = [rt._block_count(size, 20_000) * rt._block_count(100 * size, 20_000) for size in (10_000, 500_000, 5_000_000)]
    assert cells == [8, 64, rt.GRID_BLOCKS * 15]
    # Beyond that many blocks of the usual size there are as many as memory asks for, and no larger ones.
    assert rt._block_count(100 * rt.BLOCK_BYTES, 20_000) == rt._block_count(100 * rt.BLOCK_BYTES, rt.BLOCK_BYTES) == 100
    assert rt._block_count(40, 20) == 2 and rt._block_count(0, 20) == 1


def test_knn_edges(spark):
    cdf = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, embedding array<double>")
    none = spark.createDataFrame([], "query_id long, embedding array<double>")
    assert rt.knn(none, cdf, 3).count() == 0
    q = spark.createDataFrame([(9, [1.0, 1.0])], "query_id long, embedding array<double>")
    assert [(r.id, r.rank) for r in rt.knn(q, cdf, 3).collect()] == [(1, 1)]
    assert rt.knn(q, cdf, 3, where=F.col("id") > 5).count() == 0


def test_groups_are_skipped():
    """Vectors in clusters: most groups cannot hold a neighbour, and the result stays exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    corpus = rt._unit(np.concatenate([c + 0.05 * rng.normal(size=(200, 16)) for c in centres]))
    queries = rt._unit(np.concatenate([c + 0.05 * rng.normal(size=(3, 16)) for c in centres]))
    seen = {}
    got = rt.search_block(np.arange(60), queries, np.arange(4000), corpus, corpus[::80], 10, seen)
    scores = np.round(queries @ corpus.T, rt.DIGITS)
    for q, rows in got.groupby("query_id"):
        want = sorted(range(4000), key=lambda i: (-scores[q, i], i))[:10]
        assert list(rows["id"]) == want
    assert seen["scored"] < 0.25 * seen["pairs"]


def test_corpus_is_read_once_for_any_number_of_query_blocks(spark, tmp_path):
    """Blocks of queries share the postings: no more jobs, and the corpus expression runs once a row."""
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common") for i in range(60)], "id long, text string")
    asked = spark.createDataFrame([(i, f"w{i} common") for i in range(12)], "query_id long, query string")
    out = {}
    for terms in (10_000, 2):
        reads.value = 0
        corpus = docs.mapInArrow(counted, docs.schema)
        out[terms] = sorted(map(tuple, rt.bm25(asked, corpus, 3, query_terms=terms).collect()))
        assert reads.value == 60
    assert out[2] == out[10_000]


def toks(s):
    return [t for t in re.split(r"[\W_]+", s.lower()) if t]


@pytest.mark.parametrize("query_terms, terms", [(10_000, 1_000_000), (2, 7)])
def test_bm25_equals_brute_force(spark, monkeypatch, query_terms, terms):
    monkeypatch.setattr(rt, "POSTING_TERMS", terms)
    docs = ["the cat sat", "the dog the dog", "a bird", "", "cat and dog and the bird", "the the the", "unrelated words only"] * 3
    queries = {1: "the Cat cat", 2: "bird dog", 3: "nothing here"}
    n, lens = len(docs), [len(toks(d)) for d in docs]
    avg = sum(lens) / n
    want = {}
    for q, text in queries.items():
        scored = []
        for i, d in enumerate(docs):
            tf, s = Counter(toks(d)), 0.0
            for t in set(toks(text)) & set(tf):
                df = sum(t in toks(x) for x in docs)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * lens[i] / avg))
            if set(toks(text)) & set(tf):
                scored.append((-round(s, 6), i))
        if scored:
            want[q] = [(i, -s) for s, i in sorted(scored)[:4]]
    cdf = spark.createDataFrame(list(enumerate(docs)), "id long, text string").repartition(4)
    qdf = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    got = {}
    for r in rt.bm25(qdf, cdf, 4, query_terms=query_terms).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-6)


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, id long, url string, chunk_text string")


ROWS = [(1, 1, 10, "a", "alpha text one"), (1, 2, 11, "a", "beta"), (1, 3, 12, None, "gamma text"), (1, 4, 13, None, "delta"), (1, 5, 14, "b", "text eps")]


def test_diversify(spark):
    got = rt.diversify(ranked(spark, ROWS), "url", 3).orderBy("rank").collect()
    assert [(r.rank, r.id) for r in got] == [(1, 10), (2, 12), (3, 13)]


def test_rerank(spark):
    df = ranked(spark, ROWS)
    assert [r.id for r in rt.rerank(df, F.length("chunk_text"), 2).orderBy("rank").collect()] == [10, 12]
    # A failed score keeps the order, and still only k rows.
    failing = F.when(F.col("id") != 12, F.length("chunk_text"))
    assert [r.id for r in rt.rerank(df, failing, 2).orderBy("rank").collect()] == [10, 11]


def test_context_health_citations(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r.query_id: r.context for r in rt.build_context(q, ranked(spark, ROWS[:2])).collect()}
    assert got[1] == "[Source 1] a\nalpha text one\n\n---\n\n[Source 2] a\nbeta"
    assert got[2] == "No relevant documentation found."
    health = {r.query_id: r for r in rt.index_health(q, ranked(spark, ROWS), ["TEXT"]).collect()}
    assert health[1].results == 5 and not health[1].valid and health[1].relevance == pytest.approx(0.6)
    assert not health[2].healthy and health[2].results == 0
    answers = spark.createDataFrame([(1, "see a and c"), (2, "none")], "query_id long, answer string")
    cites = {r.query_id: (r.retrieved, r.cited) for r in rt.citation_count(answers, ranked(spark, ROWS)).collect()}
    assert cites == {1: (3, 2), 2: (0, 0)}


def test_overlap_and_fusion(spark):
    rows = ranked(spark, [(1, 1, 10, "a", ""), (1, 2, 11, "a", ""), (2, 1, 10, "a", ""), (3, 1, 12, "a", "")])
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    got = {(r.a, r.b): (r.shared, r.distinct_results) for r in rt.result_overlap(rows, pairs).collect()}
    assert got == {(1, 2): (1, False), (1, 3): (0, True), (1, 4): (0, False)}
    other = ranked(spark, [(1, 1, 11, "a", ""), (1, 2, 12, "a", "")])
    fused = rt.hybrid_search(rows.where("query_id = 1"), other, 2).orderBy("rank").collect()
    assert [r.id for r in fused] == [11, 10]


def test_embed(spark):
    df = spark.createDataFrame([("a b a",), (None,)], "t string")
    rows = [r.embedding for r in rt.embed(df, "t", lambda c: rt.hashed_tf(c, 16)).collect()]
    assert sum(rows[0]) == 3 and len(rows[0]) == 16 and sum(rows[1]) == 0
