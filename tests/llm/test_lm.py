"""Language-model scores: the base against plain counts, the model by what it must be."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa

from docsieve.llm import lm, queries


def base(rows):
    words = {i: [*brute.WORD.findall((t or "").translate(brute.FOLD)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in words.items()}


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op6_lm_scoring(spark, sf).collect()}
    want = base([tuple(r) for r in docs])
    assert set(got) == set(want)
    for i, (held, n, known, total, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, score, rel_tol=1e-9)
        assert r.score < 0
    # Better than ids by their shares alone would need the words' order; at least clean text beats a uniform choice.
    assert sum(r.score for r in got.values()) > -math.log10(lm._IDS) * 3 * sum(r.n_tokens for r in got.values())


def test_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "The the THE", None), (3, "The the THE", None), (None, "the end", "x"), (4, "w" * 5000 + " " + "ab " * 3000, "x")]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string, score string")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 4, 4, 3002]
    assert lm.score_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_probabilities_and_gradients():
    rng = np.random.default_rng(0)
    cells = (lm._IDS, lm.CELLS)
    net = lm.Attention(rng.integers(1, 50, lm._IDS), rng.integers(0, 5, cells), rng.integers(0, 5, cells))
    net.set_shares(rng.integers(0, 9, (lm.SLOTS, lm.GROUPS)), rng.integers(0, 9, (lm.GROUPS, lm._IDS)))
    # Training starts without the head's part; here it has one, so that every gradient counts.
    net.p["out"] = (rng.standard_normal(net.p["out"].shape) * 0.3).astype(np.float32)
    ids, firsts = rng.integers(0, lm._IDS, 100), np.array([0, 1, 40, 100])
    row, at = lm._places(firsts)
    inputs, valid, target, use = lm._windows(ids, firsts, row, at)
    assert sorted(target[use].tolist()) == sorted(ids.tolist())  # every token once
    z, _ = net.forward(inputs, valid)
    assert np.allclose(np.exp(z).sum(axis=2), 1, atol=1e-4)
    filled = np.unique(net.group)
    for share in net.inside:
        assert np.allclose(np.bincount(net.group, weights=np.exp(share.astype(float)))[filled], 1, atol=1e-2)
    net.scores(ids, firsts)
    assert np.allclose(net.target_logs(inputs, valid, net.group[target]), np.take_along_axis(z, net.group[target][..., None], 2)[..., 0], atol=1e-4)
    grad = net.gradients(inputs, valid, net.group[target], use)

    def loss():
        z, _ = net.forward(inputs, valid)
        return -(np.take_along_axis(z, net.group[target][..., None], 2)[..., 0] * use).sum() / use.sum()

    for name in ("wq", "wk", "wv", "wo", "out"):
        net.p[name][1, 2] += 0.01
        up = loss()
        net.p[name][1, 2] -= 0.02
        down = loss()
        net.p[name][1, 2] += 0.01
        assert abs((up - down) / 0.02 - grad[name][1, 2]) < 2e-3
    # A later token changes no earlier score.
    before = net.scores(ids, firsts)
    longer = net.scores(np.append(ids, 7), np.array([0, 1, 40, 101]))
    assert np.allclose(before[:2], longer[:2]) and longer[2] < before[2]


def test_training_takes_every_window():
    lengths, held = np.array([1, 16, 17, 500, 40], np.int32), np.array([False, False, False, False, True])
    ids = np.arange(lengths.sum(), dtype=np.uint16)
    seen = [t[u] for turn in range(lm.ROUNDS) for _, _, t, u in lm._turn_batches([(None, held, lengths, ids)], turn)]
    assert sorted(np.concatenate(seen).tolist()) == list(range(lengths[:4].sum()))


def test_rows_keep_their_scores_when_the_input_moves(spark):
    # The input comes in another order each time it is worked out, as after a shuffle that is run again.
    def shuffled(batches):
        table = pa.Table.from_batches(batches)
        yield from table.take(pa.array(np.random.default_rng().permutation(table.num_rows))).to_batches()

    words = [(i, f"word{i} " * (i + 1)) for i in range(200)]
    moving = spark.createDataFrame(words, "doc_id bigint, text string").repartition(1).mapInArrow(shuffled, "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in lm.score_documents(moving).collect()}
    assert got == {i: i + 2 for i in range(200)}


def test_kinds_give_what_windows_give():
    rng = np.random.default_rng(1)
    cells = (lm._IDS, lm.CELLS)
    net = lm.Attention(rng.integers(0, 50, lm._IDS), rng.integers(0, 5, cells), rng.integers(0, 5, cells))
    net.set_shares(rng.integers(0, 9, (lm.SLOTS, lm.GROUPS)), rng.integers(0, 9, (lm.GROUPS, lm._IDS)))
    ids, firsts = rng.integers(0, lm._IDS, 5000), np.array([0, 1, 40, 4000, 5000])
    inputs, valid, target, use = lm._windows(ids, firsts, *lm._places(firsts))
    # Weights so large that exponentials would overflow, too.
    for size in (0.3, 200):
        net.p["out"] = (rng.standard_normal(net.p["out"].shape) * size).astype(np.float32)
        net.ready()
        # Ids that enter alike are worked out once.
        assert len(net.asks) == len(net.holds) <= lm.SLOTS - 1 + lm.GROUPS
        z, _ = net.forward(inputs, valid)
        want = np.take_along_axis(z, net.group[target][..., None], 2)[..., 0]
        got = net.target_logs(inputs, valid, net.group[target])
        assert np.isfinite(got[use]).all() and np.allclose(got[use], want[use], rtol=1e-4, atol=1e-4)
        assert all(np.isfinite(g).all() for g in net.gradients(inputs, valid, net.group[target], use).values())
