"""Language-model scores: word counts as the base, and a small causal self-attention model on subword ids in numpy."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm import segments as seg
from docsieve.llm.subwords import default_vocabulary, subwords
from docsieve.session import cut_lineage

TASK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
# Words whose counts go to every task, at most: they are in most documents.
COMMON = 1 << 15
# The model: groups of ids, embedded ids, width, tokens scored and tokens of context in a window.
GROUPS, SLOTS, WIDTH, STRIDE, CONTEXT = 48, 4096, 16, 16, 8
ROUNDS, BATCH, RATE = 3, 64, 0.01
# Windows scored at a time, few enough to stay in a core's cache.
SCORED = 256
# Below this no exponential and no sum of them overflows a float32.
SAFE = 40
# Neighbours of an id are told apart in so many cells when ids are grouped; counts that a smoothed share is worth.
CELLS, TRUST = 32, 20
END_WORD = np.uint64(0x9E3779B97F4A7C15)
_IDS = 49_408


# ---------------------------------------------------------------- word counts


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the row of each, one end per row included."""
    data, offsets = seg.text_bytes(batch.column("text"))
    low = seg.lower_ascii(data)
    starts, ends, firsts = seg.word_bounds(low, offsets)
    n = batch.num_rows
    return np.append(seg.segment_hashes(low, starts, ends, 11), np.full(n, END_WORD)), np.append(seg.rows_of(firsts), np.arange(n))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by the last key first, and where a new combination starts in it."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _count_words(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in seg.batches_of(batches, "text", TASK_BYTES):
            keys, _ = _words(batch)
            keys, counts = np.unique(keys, return_counts=True)
            bucket = (keys % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
            rows = [(int(bucket[order[a]]), keys[order[a:b]].tobytes(), seg.planes(counts[order[a:b]])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "keys", "counts"])

    return run


def _sum_words(group: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in group["keys"].to_pylist()])
    counts = np.concatenate([seg.from_planes(x, np.int64) for x in group["counts"].to_pylist()])
    uniq, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back, weights=counts).astype(np.int64)
    top = np.argsort(-total, kind="stable")[:1024]
    return pa.table({
        "bucket": pa.array([group["bucket"][0].as_py()], pa.int32()), "keys": [uniq.tobytes()], "counts": [seg.planes(total)], "n": pa.array([int(total.sum())], pa.int64()),
        "v": pa.array([len(uniq)], pa.int64()), "top_keys": pa.array([uniq[top].view(np.int64).tolist()], pa.list_(pa.int64())), "top_counts": pa.array([total[top].tolist()], pa.list_(pa.int64())),
    })


# ---------------------------------------------------------------- the model


def _groups(counts: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A group for each id: k-means over what comes after and before it; ids hardly seen share the last group."""
    profile = [np.sqrt(t / np.maximum(t.sum(axis=1, keepdims=True), 1)) for t in (after.astype(np.float32), before.astype(np.float32))]
    profile = np.concatenate(profile, axis=1)
    order = np.argsort(-counts, kind="stable")
    seen = order[counts[order] >= 5]
    group = np.full(len(counts), GROUPS - 1, np.int32)
    if not len(seen):
        return group
    points, mass = profile[seen], counts[seen].astype(np.float32)
    centres = points[: GROUPS - 1].copy()
    for _ in range(10):
        label = (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        for k in np.unique(label):
            centres[k] = np.average(points[label == k], axis=0, weights=mass[label == k])
    group[seen] = label
    return group


def _exp(values: np.ndarray, bound: float) -> np.ndarray:
    """Exponentials in place and their sums over the last axis; rows are shifted by their largest value only where ``bound`` does not keep them small."""
    if not bound < SAFE:
        values -= values.max(axis=-1, keepdims=True)
    np.exp(values, out=values)
    return values @ np.ones(values.shape[-1], np.float32)


class Attention:
    """One causal head over groups of ids.

    It adds to the log shares that the groups have after the id before, by the
    counts of all training texts; an id's share of its group comes from the
    counts after the group of the id before.
    """

    def __init__(self, counts: np.ndarray, after: np.ndarray, before: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.share = (counts + 0.5) / (counts.sum() + 0.5 * len(counts))
        self.group = _groups(counts, after, before)
        self.slot = np.zeros(len(counts), np.int32)
        self.slot[np.argsort(-counts, kind="stable")[: SLOTS - 1]] = np.arange(1, SLOTS)
        # Ids that enter the head alike are one kind: a slot and a group.
        kinds, self.kind = np.unique(self.slot * GROUPS + self.group, return_inverse=True)
        self.kind_slot, self.kind_group = kinds // GROUPS, kinds % GROUPS
        d = WIDTH
        shapes = {"slot": (SLOTS, d), "grp": (GROUPS, d), "wq": (d, d), "wk": (d, d), "wv": (d, d), "wo": (d, d)}
        self.p = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in shapes.items()}
        self.p |= {"pos": np.zeros(STRIDE + CONTEXT, np.float32), "out": np.zeros((d, GROUPS), np.float32)}
        back = (CONTEXT + np.arange(STRIDE))[:, None] - np.arange(STRIDE + CONTEXT)[None, :]
        self.back = np.clip(back, 0, STRIDE + CONTEXT - 1)
        self.hidden = np.where(back >= 0, 0, -1e9).astype(np.float32)

    def set_shares(self, groups_after: np.ndarray, ids_after: np.ndarray) -> None:
        """From counts: groups after each slot, ids after each group."""
        mass = np.bincount(self.group, weights=self.share, minlength=GROUPS)
        self.bigram = np.log((groups_after + TRUST * np.maximum(mass, 1e-12)) / (groups_after.sum(axis=1, keepdims=True) + TRUST)).astype(np.float32)
        self.inside = np.empty((GROUPS, len(self.share)), np.float16)
        own = self.share / mass[self.group]
        for g, row in enumerate(ids_after):
            total = np.bincount(self.group, weights=row, minlength=GROUPS)
            self.inside[g] = np.log((row + TRUST * own) / (total[self.group] + TRUST))

    def _attend(self, q: np.ndarray, k: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of all places for the last ``STRIDE`` of each window, not yet divided by their sums, and these."""
        p = self.p
        s = q @ k.transpose(0, 2, 1)
        s += p["pos"][self.back] + self.hidden
        cut = np.flatnonzero(~valid.all(axis=1))
        if len(cut):
            s[cut] += np.where(valid[cut], 0, np.float32(-1e9))[:, None, :]
        return s, _exp(s, WIDTH * np.abs(q).max(initial=0) * np.abs(k).max(initial=0) + np.abs(p["pos"]).max())

    def _logits(self, ids: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The head's part and the groups' log shares after the id before, of every place scored; windows lie in a row, so that a product is one call."""
        p, n, d = self.p, len(ids), WIDTH
        kind = self.kind[ids]
        x = (p["slot"][self.kind_slot[kind]] + p["grp"][self.kind_group[kind]]).reshape(-1, d)
        last = x.reshape(n, -1, d)[:, CONTEXT:].reshape(-1, d)
        q, k, v = (last @ (p["wq"] / np.float32(np.sqrt(d)))).reshape(n, -1, d), (x @ p["wk"]).reshape(n, -1, d), (x @ p["wv"]).reshape(n, -1, d)
        s, total = self._attend(q, k, valid)
        s /= total[..., None]
        o = (s @ v).reshape(-1, d)
        h = np.tanh(o @ p["wo"])
        z = h @ p["out"]
        z += self.bigram[self.slot[ids[:, CONTEXT:]].ravel()]
        return z, (kind, x, last, q, k, v, s, o, h)

    def forward(self, ids: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Log shares of all groups for the last ``STRIDE`` places of each window (windows x (context + stride) inputs)."""
        z, held = self._logits(ids, valid)
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z.reshape(len(ids), STRIDE, GROUPS), held

    def gradients(self, ids: np.ndarray, valid: np.ndarray, target: np.ndarray, use: np.ndarray) -> dict[str, np.ndarray]:
        dz, (kind, x, last, q, k, v, s, o, h) = self._logits(ids, valid)
        p, n, d = self.p, len(ids), WIDTH
        weight = (use.ravel() / max(use.sum(), 1)).astype(np.float32)
        dz *= (weight / _exp(dz, np.abs(p["out"]).sum(axis=0).max()))[:, None]
        dz[np.arange(len(dz)), target.ravel()] -= weight
        g = {"out": h.T @ dz}
        da = (dz @ p["out"].T) * (1 - h * h)
        g["wo"] = o.T @ da
        do = (da @ p["wo"].T).reshape(n, -1, d)
        dv = (s.transpose(0, 2, 1) @ do).reshape(-1, d)
        ds = do @ v.transpose(0, 2, 1)
        ds *= s
        ds -= s * (ds @ np.ones(ds.shape[2], np.float32))[..., None]
        g["pos"] = np.bincount(self.back.ravel(), weights=ds.sum(axis=0).ravel(), minlength=len(p["pos"])).astype(np.float32)
        dq, dk = (ds @ k).reshape(-1, d), (ds.transpose(0, 2, 1) @ q).reshape(-1, d)
        dq /= np.float32(np.sqrt(d))
        g["wq"], g["wk"], g["wv"] = last.T @ dq, x.T @ dk, x.T @ dv
        dx = dk @ p["wk"].T
        dx += dv @ p["wv"].T
        dx.reshape(n, -1, d)[:, CONTEXT:] += (dq @ p["wq"].T).reshape(n, -1, d)
        # Sums by kind, then those of a slot and of a group.
        flat = kind.ravel()
        order = np.argsort(flat, kind="stable")
        own = flat[order]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sums, kinds = np.add.reduceat(dx[order], heads, axis=0), own[heads]
        for name, index in (("slot", self.kind_slot[kinds]), ("grp", self.kind_group[kinds])):
            # In order of kinds the slots are in order as well; the groups are few.
            g[name] = np.zeros_like(p[name])
            if name == "slot":
                first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
                g[name][index[first]] = np.add.reduceat(sums, first, axis=0)
            else:
                g[name] += (index == np.arange(GROUPS)[:, None]).astype(np.float32) @ sums
        return g

    def train(self, batches: Iterator[tuple[np.ndarray, ...]]) -> None:
        """One pass of Adam over batches of windows; all parameters lie in one array."""
        names, shapes = sorted(self.p), [self.p[k].shape for k in sorted(self.p)]
        flat = np.concatenate([self.p[k].ravel() for k in names])
        cuts = np.cumsum([self.p[k].size for k in names])[:-1]
        self.p = {k: part.reshape(shape) for k, part, shape in zip(names, np.split(flat, cuts), shapes, strict=True)}
        m, w, g, t = (np.zeros_like(flat) for _ in range(4))
        for step, (ids, valid, target, use) in enumerate(batches, 1):
            found = self.gradients(ids, valid, self.group[target], use)
            np.concatenate([found[k].ravel() for k in names], out=g)
            m *= 0.9
            m += np.multiply(g, 0.1, out=t)
            w *= 0.99
            np.multiply(g, g, out=t)
            t *= 0.01
            w += t
            np.divide(w, 1 - 0.99**step, out=t)
            np.sqrt(t, out=t)
            t += 1e-6
            np.divide(m, t, out=t)
            t *= RATE / (1 - 0.9**step)
            flat -= t

    def ready(self) -> None:
        """Keys, queries and values of all kinds and the groups' shares, which no longer change, for ``target_logs``."""
        p = self.p
        x = p["slot"][self.kind_slot] + p["grp"][self.kind_group]
        self.asks = x @ (p["wq"] / np.float32(np.sqrt(WIDTH)))
        self.holds = np.hstack([x @ p["wk"], x @ p["wv"] @ p["wo"]])
        self.after = np.exp(self.bigram)

    def target_logs(self, ids: np.ndarray, valid: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """The log shares of the given groups as ``forward`` has them, with the products of each kind made once."""
        p, n, d = self.p, len(ids), WIDTH
        kind = self.kind[ids]
        holds = self.holds[kind]
        s, total = self._attend(self.asks[kind[:, CONTEXT:]], holds[..., :d], valid)
        o = s @ holds[..., d:]
        o /= total[..., None]
        z = np.tanh(o, out=o).reshape(-1, d) @ p["out"]
        slot, at = self.slot[ids[:, CONTEXT:]].ravel(), groups.ravel()
        own = z[np.arange(len(z)), at] + self.bigram[slot, at]
        if not np.abs(p["out"]).sum(axis=0).max() < SAFE:
            top = z.max(axis=1)
            z -= top[:, None]
            own -= top
        np.exp(z, out=z)
        return (own - np.log(np.einsum("ij,ij->i", z, self.after[slot]))).reshape(n, STRIDE)

    def scores(self, ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        self.ready()
        total = np.zeros(len(firsts) - 1)
        row, at = _places(firsts)
        for i in range(0, len(row), SCORED):
            r = row[i : i + SCORED]
            inputs, valid, target, use = _windows(ids, firsts, r, at[i : i + SCORED])
            logs = self.target_logs(inputs, valid, self.group[target]) + self.inside[self.group[inputs[:, CONTEXT:]], target]
            total += np.bincount(r, weights=np.where(use, logs, 0).sum(axis=1), minlength=len(total))
        return total / np.log(10)


def _places(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the first scored place of every window: each place is scored in one window."""
    counts = -(-np.diff(firsts) // STRIDE)
    row = np.repeat(np.arange(len(counts)), counts)
    return row, (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE


def _windows(ids: np.ndarray, firsts: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Inputs (each place sees the ids before it), which of them are real, the ids to score and which of those are real."""
    n = np.diff(firsts)[row][:, None]
    place = at[:, None] + np.arange(-CONTEXT, STRIDE)[None, :]
    base = firsts[row][:, None]
    valid = (place >= 0) & (place <= n)
    before = np.where((place > 0) & (place <= n), ids[np.clip(base + place - 1, 0, len(ids) - 1)], 0)
    target = place[:, CONTEXT:]
    use = target < n
    return before, valid, np.where(use, ids[np.clip(base + target, 0, len(ids) - 1)], 0), use


def _sparse(total: np.ndarray) -> bytes:
    at = np.flatnonzero(total)
    return zlib.compress(np.concatenate([np.diff(at, prepend=0), total[at]]).tobytes(), 1)


def _add_sparse(parts: list[bytes], size: int) -> np.ndarray:
    total = np.zeros(size, np.int64)
    for part in parts:
        steps, counts = np.frombuffer(zlib.decompress(part), np.int64).reshape(2, -1)
        total[np.cumsum(steps)] += counts
    return total


# A block of texts in ids, or what a task has counted.
_BLOCK = ["rows", "held", "lengths", "ids", "counts"]


def _block(**cols: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([cols.get(c)], pa.binary()) for c in _BLOCK], _BLOCK)


def _ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows, which are held out, lengths and ids of each block of texts."""
    for batch in batches:
        for raw in batch.select(_BLOCK[:4]).to_pylist():
            yield tuple(np.frombuffer(raw[c], t) for c, t in zip(_BLOCK, (np.int64, bool, np.int32, np.uint16), strict=False))


def check_vocabulary(vocabulary: str) -> None:
    """Ids are stored in tables of a fixed size; a larger vocabulary is refused."""
    size = subwords(vocabulary).tokenizer.get_vocab_size()
    if size > _IDS:
        raise ValueError(f"the vocabulary has {size} ids, at most {_IDS} fit")


def _encode(vocabulary: str):
    """Texts as ids, so that no later pass cuts them up again.

    Besides, of training texts, counts of ids and of cells of ids after and
    before them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords(vocabulary)
        total = np.zeros((1 + 2 * CELLS) * _IDS, np.int64)
        counts, after, before = np.split(total, [_IDS, (1 + CELLS) * _IDS])
        for batch in seg.batches_of(batches, "text", TASK_BYTES):
            ids, firsts = coder.documents(batch.column("text"), 0)
            rows, held = batch.column("row").to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            n = np.diff(firsts)
            blocks = {"rows": rows.tobytes(), "held": held.tobytes(), "lengths": n.astype(np.int32).tobytes(), "ids": ids.astype(np.uint16).tobytes()}
            ids, n = ids[np.repeat(~held, n)].astype(np.int64), n[~held]
            if len(n):
                counts += np.bincount(ids, minlength=_IDS)
                last = np.append(0, ids[:-1])
                after += np.bincount(last * CELLS + ids % CELLS, minlength=len(after))
                before += np.bincount(ids * CELLS + last % CELLS, minlength=len(before))
            yield _block(**blocks)
        yield _block(counts=_sparse(total))

    return run


def _pair_counts(slot: np.ndarray, group: np.ndarray):
    """Of training texts, counts of groups after the slot before, and of ids after the group before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS * GROUPS + GROUPS * _IDS, np.int64)
        groups, pairs = np.split(total, [SLOTS * GROUPS])
        for _, held, lengths, ids in _ids_of(batches):
            ids = ids[np.repeat(~held, lengths)]
            if len(ids):
                last = np.append(np.uint16(0), ids[:-1])
                groups += np.bincount(slot[last] * GROUPS + group[ids], minlength=len(groups))
                pairs += np.bincount(group[last] * _IDS + ids, minlength=len(pairs))
        yield pa.RecordBatch.from_arrays([pa.array([_sparse(total)], pa.binary())], ["data"])

    return run


def _summed(counted: DataFrame, size: int) -> np.ndarray:
    """The sum of sparse tables of a fixed size: in Spark by parts, the last sixteen here."""

    def add(group: pa.Table) -> pa.Table:
        return pa.table({"data": pa.array([_sparse(_add_sparse(group["data"].to_pylist(), size))], pa.binary())})

    parts = counted.groupBy(F.pmod(F.xxhash64("data"), F.lit(16))).applyInArrow(add, "data binary")
    return _add_sparse([bytes(r["data"]) for r in parts.collect()], size)


def _turn_batches(blocks: Iterator[tuple[np.ndarray, ...]], turn: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of every training text the windows of one round, in batches and mixed within a block; the rounds together take each window once."""
    rng = np.random.default_rng(turn)
    for _, held, lengths, ids in blocks:
        ids, firsts = ids[np.repeat(~held, lengths)].astype(np.int32), np.append(0, np.cumsum(lengths[~held], dtype=np.int64))
        row, at = _places(firsts)
        order = rng.permutation(np.flatnonzero((row + at // STRIDE) % ROUNDS == turn))
        for i in range(0, len(order), 16 * BATCH):
            own = order[i : i + 16 * BATCH]
            made = _windows(ids, firsts, row[own], at[own])
            for j in range(0, len(own), BATCH):
                yield tuple(a[j : j + BATCH] for a in made)


def _local_training(model: bytes, turn: int):
    """One task trains its own copy on its windows of this round; copies are averaged by the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(model)
        seen = 0

        def counted() -> Iterator[tuple[np.ndarray, ...]]:
            nonlocal seen
            for windows in _turn_batches(_ids_of(batches), turn):
                seen += len(windows[0])
                yield windows

        net.train(counted())
        if seen:
            flat = np.concatenate([net.p[k].ravel() for k in sorted(net.p)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([np.append(flat * seen, seen).tobytes()], pa.binary())], ["salt", "data"])

    return run


def _add_models(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.float64) for x in group["data"].to_pylist()], axis=0)
    return pa.table({"data": pa.array([total.tobytes()], pa.binary())})


def fit(encoded: DataFrame) -> Attention:
    """Counts of all training ids and of their neighbours, then rounds of local training that take every window of every training text once.

    What a task sends has a fixed size, and sums are added in two steps; the
    windows are made from the blocks of ids, a few at a time.
    """
    gathered = encoded.where("counts is not null").select(F.col("counts").alias("data"))
    counts, after, before = np.split(_summed(gathered, (1 + 2 * CELLS) * _IDS), [_IDS, (1 + CELLS) * _IDS])
    net = Attention(counts, after.reshape(_IDS, CELLS), before.reshape(_IDS, CELLS))
    pairs = encoded.where("ids is not null").mapInArrow(_pair_counts(net.slot, net.group), "data binary")
    groups, pairs = np.split(_summed(pairs, SLOTS * GROUPS + GROUPS * _IDS), [SLOTS * GROUPS])
    net.set_shares(groups.reshape(SLOTS, GROUPS), pairs.reshape(GROUPS, _IDS))
    blocks = encoded.where("ids is not null")
    for turn in range(ROUNDS):
        sent = blocks.mapInArrow(_local_training(pickle.dumps(net), turn), "salt bigint, data binary")
        rows = sent.groupBy(F.pmod(F.xxhash64("data"), F.lit(16))).applyInArrow(_add_models, "data binary").collect()
        if not rows:
            break
        total = np.sum([np.frombuffer(r["data"], np.float64) for r in rows], axis=0)
        flat, at = total[:-1] / total[-1], 0
        for k in sorted(net.p):
            size = net.p[k].size
            net.p[k] = flat[at : at + size].reshape(net.p[k].shape).astype(np.float32)
            at += size
    return net


# ---------------------------------------------------------------- scores

_PART = "bucket int, kind int, rows binary, a binary, b binary, c binary, d binary"
_PART_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("rows", "a", "b", "c", "d")]])


def _parts_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_PART_SCHEMA)], schema=_PART_SCHEMA)


def _model_scores(n: int, net: Attention):
    """What the model gives each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, _, lengths, ids in _ids_of(batches):
            score = net.scores(ids.astype(np.int32), np.append(0, np.cumsum(lengths, dtype=np.int64)))
            to = names % n
            yield _parts_of([(int(t), 0, names[to == t].tobytes(), None, None, None, score[to == t].tobytes()) for t in np.unique(to)])

    return run


def _entries(n: int, common: np.ndarray, counts: np.ndarray):
    """Per block: what the common words and the sizes give each row, and the other words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in seg.batches_of(batches, "text", TASK_BYTES):
            names = batch.column("row").to_numpy()
            keys, rows = _words(batch)
            at = np.minimum(np.searchsorted(common, keys), max(len(common) - 1, 0))
            hit = common[at] == keys if len(common) else np.zeros(len(keys), bool)
            logs = np.bincount(rows[hit], weights=np.log10(counts[at[hit]] + 1.0), minlength=len(names))
            known = np.bincount(rows[hit], minlength=len(names)).astype(np.int64)
            size = np.bincount(rows, minlength=len(names)).astype(np.int64)
            to = names % n
            out = []
            for t in np.unique(to):
                m = to == t
                out.append((int(t), 0, names[m].tobytes(), logs[m].tobytes(), known[m].tobytes(), size[m].tobytes(), None))
            keys, rows = keys[~hit], rows[~hit]
            bucket = (keys % np.uint64(n)).astype(np.int64)
            order, first = _runs(rows, keys, bucket)
            times = np.diff(np.append(first, len(order))).astype(np.uint32)
            own = order[first]
            b = bucket[own]
            cuts = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
            local = rows[own].astype(np.uint32)
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                # Words once, with the number of rows that hold each; rows by their place in the block's list.
                k = keys[own[x:y]]
                head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                many = np.diff(np.append(head, len(k))).astype(np.uint32)
                out.append((int(b[x]), 1, seg.planes(names[local[x:y]]), k[head].tobytes(), seg.planes(many), seg.planes(times[x:y]), b""))
            for i in range(0, len(out), 64):
                yield _parts_of(out[i : i + 64])

    return run


def _look_up(n: int):
    """In one bucket of words: what each row gets from its words, sent on by row; other parts pass through."""

    def run(parts: pa.Table, counted: pa.Table) -> pa.Table:
        out = [tuple(r.values()) for r in parts.filter(pa.compute.equal(parts["kind"], 0)).to_pylist()]
        words = parts.filter(pa.compute.equal(parts["kind"], 1)).to_pylist()
        known = [(np.frombuffer(r["keys"], np.uint64), seg.from_planes(r["counts"], np.int64)) for r in counted.to_pylist()]
        keys, counts = known[0] if known else (np.empty(0, np.uint64), np.empty(0, np.int64))
        found = []
        for r in words:
            k = np.frombuffer(r["a"], np.uint64)
            c = np.zeros(len(k), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                c = np.where(keys[at] == k, counts[at], 0)
            c = np.repeat(c, seg.from_planes(r["b"], np.uint32).astype(np.int64))
            times, rows = seg.from_planes(r["c"], np.uint32), seg.from_planes(r["rows"], np.int64)
            uniq, back = np.unique(rows, return_inverse=True)
            logs = np.bincount(back, weights=times * np.log10(c + 1.0))
            seen = np.bincount(back, weights=times * (c > 0)).astype(np.int64)
            hit = seen > 0
            found.append((uniq[hit], logs[hit], seen[hit]))
        if found:
            # One row for each part of the documents, whatever number of blocks came in.
            rows, logs, seen = (np.concatenate(x) for x in zip(*found, strict=True))
            to = rows % n
            order = np.argsort(to, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(to[order], prepend=-1)), len(order))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[x:y]
                out.append((int(to[at[0]]), 0, rows[at].tobytes(), logs[at].tobytes(), seen[at].tobytes(), None, None))
        return pa.Table.from_batches([_parts_of(out)])

    return run


def _total(group: pa.Table) -> pa.Table:
    """The sums of each row."""
    parts = group.to_pylist()
    rows = np.concatenate([np.frombuffer(r["rows"], np.int64) for r in parts])
    uniq, back = np.unique(rows, return_inverse=True)

    def add(name: str, kind: type) -> np.ndarray:
        values = [np.frombuffer(r[name], kind) if r[name] else np.zeros(len(r["rows"]) // 8, kind) for r in parts]
        return np.bincount(back, weights=np.concatenate(values).astype(float), minlength=len(uniq))

    return pa.table({
        "row": uniq, "logs": add("a", np.float64), "n_known": add("b", np.int64).astype(np.int64), "n_tokens": add("c", np.int64).astype(np.int64), "score": add("d", np.float64),
    })


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows whose checksum of the id modulo 7 is 2 are held out; counts and model
    come from all others. Null and empty texts have one token, the end. Rows
    without an id are in training; repeated rows count each. Words are told
    apart by a 64-bit hash. ``score`` is the model's log10 probability of the
    subword ids and the end; ids outside the training texts have a small share.
    """
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()
    check_vocabulary(path)
    part = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(part, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    # Written once, so that every later job sees the same rows under the same numbers.
    rows = cut_lineage(rows, "rows")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    training = rows.where(~F.col("held_out")).select("text")
    words = training.mapInArrow(_count_words(n), "bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(
        _sum_words, "bucket int, keys binary, counts binary, n bigint, v bigint, top_keys array<bigint>, top_counts array<bigint>"
    )
    words = cut_lineage(words, "words")
    sizes = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    top = words.select(F.explode(F.arrays_zip("top_keys", "top_counts")).alias("t")).select("t.*")
    top = sorted((r["top_keys"] % (1 << 64), r["top_counts"]) for r in top.orderBy(F.desc("top_counts"), "top_keys").limit(COMMON).collect())
    common, counts = np.array([k for k, _ in top], np.uint64), np.array([c for _, c in top], np.int64)
    schema = ", ".join(f"{c} binary" for c in _BLOCK)
    encoded = cut_lineage(rows.select("row", "held_out", "text").mapInArrow(_encode(path), schema), "ids")
    net = fit(encoded)
    # Ids of rows, their texts' parts and what the words give meet by row.
    parts = rows.select("row", "text").mapInArrow(_entries(n, common, counts), _PART)
    counted = words.select("bucket", "keys", "counts")
    looked = parts.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(_look_up(n), _PART)
    scored = encoded.where("ids is not null").mapInArrow(_model_scores(n, net), _PART)
    sums = looked.union(scored).groupBy("bucket").applyInArrow(_total, "row bigint, logs double, n_known bigint, n_tokens bigint, score double")
    floor = float(np.log10(sizes["n"] + sizes["v"] + 1))
    scores = rows.select("row", "doc_id", "held_out").join(sums, "row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(sizes["n"])).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * floor).alias("base_score"), "score",
    )
    scores = cut_lineage(scores, "scores")
    given, scored = rows.count(), scores.count()
    if given != scored:
        raise RuntimeError(f"{scored} of {given} rows have a score")
    return scores
