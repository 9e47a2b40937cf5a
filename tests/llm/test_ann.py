"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import ann, queries


def brute(ids, v, asked, k=10):
    out = {}
    for q in asked:
        d = np.sqrt(((v - v[ids.index(q)]) ** 2).sum(axis=1))
        order = sorted((d[i], ids[i]) for i in range(len(ids)) if ids[i] != q)
        out[q] = order[:k]
    return out


def recall(got, want):
    hits = sum(len({i for _, i in want[q]} & {i for _, i, _ in got.get(q, [])}) for q in want)
    return hits / sum(len(w) for w in want.values())


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_query(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    ids, v = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = brute(ids, v, [i for i in ids if i % 100 == 0])
    got = collected(queries.op8_nearest(spark, path))
    assert set(got) == set(want)
    assert recall(got, want) >= 0.9
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == pytest.approx(float(np.sqrt(((v[ids.index(q)] - v[ids.index(i)]) ** 2).sum())), rel=1e-12)


def test_bad_rows_copies_and_few_candidates(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0], "x") for i in range(0, 300)]
    rows += [(1000 + i, [float(x) for x in rng.normal(size=3)], None) for i in range(30)]
    bad = [(None, [1.0, 1.0, 1.0], "x"), (2000, None, "x"), (2100, [0.0, 0.0, 0.0], "x"), (2200, [float("nan"), 1.0, 1.0], "x"), (2300, [1.0, None, 1.0], "x"), (2400, [], "x"), (2500, [1.0], "x"), (2600, [float("inf"), 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, score string")
    got = collected(ann.nearest(df, F.col("vec_id") % 100 == 0))
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows], np.float32).astype(float)
    want = brute(ids, v, [0, 100, 200, 1000])
    assert {q: [i for _, i, _ in f] for q, f in got.items() if q < 1000} == {q: [i for _, i in w] for q, w in want.items() if q < 1000}
    assert set(got) == set(want) and len(got[1000]) == 10


def test_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in (0, 5, 7)], "vec_id bigint, embedding array<float>")
    assert [i for _, i, _ in collected(ann.nearest(df, F.col("vec_id") == 0))[0]] == [5, 7]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 5"), F.col("vec_id") == 5).count() == 0


def test_buckets_alone_reach_the_recall():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4000, 32))
    q = v[::100]
    index = ann.fit(v, len(v), 10)
    keys = []
    for t in range(ann.TABLES):
        k = index.buckets(v, t)
        order = np.argsort(k, kind="stable")
        keys.append((order, k[order]))
        assert (index.visited(q, t)[:, 0] == k[::100]).all()
    inside = ann._candidates(index, v, keys, q)
    near = np.argsort(((q[:, None] - v[None]) ** 2).sum(axis=2), axis=1)[:, 1:11]
    assert np.take_along_axis(inside, near, 1).mean() >= 0.9
    assert inside.mean() < 0.8


def test_moves_never_go_both_ways():
    moves = ann.steps_in_order(4, 1000)
    assert len(moves) == 3**4 and not (moves & moves[:, ::-1]).any()
    assert len({tuple(m) for m in moves}) == len(moves)


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, *rows[:5], (0, v[0].tolist()), (3, (v[3] + 9).tolist())], "vec_id bigint, embedding array<double>")
    got = collected(ann.nearest(df, F.col("vec_id") % 20 == 0))
    least = v.copy()
    least[3] = min(v[3].tolist(), (v[3] + 9).tolist())
    want = brute(list(range(60)), least, [0, 20, 40])
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11)) and len({i for _, i, _ in found} - {q}) == 10
        assert all(np.isclose(s, np.linalg.norm(least[q] - least[i])) for _, i, s in found)
