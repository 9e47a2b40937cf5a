"""Document quality: random Fourier features of text statistics, a ridge fit and isotonic calibration."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm import segments as seg
from docsieve.session import cut_lineage

TASK_BYTES = 1 << 20
FEATURES = 256
# Width of the Gaussian kernel in standard deviations of one statistic, times the root of their number.
WIDTH = 1.0
RIDGE = 1e-3
BINS = 4096
THRESHOLD = 0.3
FOLDS = 5
STATS = [
    "log_words", "log_chars", "word_len", "word_len_sd", "upper", "digit", "space", "wide", "pipe", "bang", "symbol", "stop", "comma",
    "title_words", "caps_words", "distinct", "top_word", "adjacent", "distinct_pairs", "log_lines", "symbol_words", "pipe_words", "long_word",
]


def _byte_classes() -> dict[str, np.ndarray]:
    def of(chars) -> np.ndarray:
        t = np.zeros(256, bool)
        t[list(chars)] = True
        return t

    return {
        "upper": of(range(65, 91)), "digit": of(range(48, 58)), "space": seg._SPACE, "wide": of(range(0xC0, 256)), "pipe": of(b"|"), "bang": of(b"!"),
        "symbol": of(b"#$%&*+<=>@\\^_`{}~"), "stop": of(b".?;:"), "comma": of(b",'\"()-"),
    }


_CLASSES = _byte_classes()


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.float64))
    return total[firsts[1:]] - total[firsts[:-1]]


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATS`` for each text; empty texts give zeros."""
    n_bytes = np.diff(offsets).astype(np.float64)
    starts, ends, firsts = seg.word_bounds(data, offsets)
    n = np.diff(firsts).astype(np.float64)
    row = seg.rows_of(firsts)
    chars = _sums((data & 0xC0) != 0x80, offsets)
    per_char, per_word = np.maximum(chars, 1), np.maximum(n, 1)
    out = {"log_words": np.log1p(n), "log_chars": np.log1p(chars)}
    for name, members in _CLASSES.items():
        out[name] = _sums(members[data], offsets) / per_char
    length = (ends - starts).astype(np.float64)
    out["word_len"] = _sums(length, firsts) / per_word
    out["word_len_sd"] = np.sqrt(np.maximum(_sums(length**2, firsts) / per_word - out["word_len"] ** 2, 0))
    out["long_word"] = np.log1p(np.maximum.reduceat(np.append(length, 0), np.minimum(firsts[:-1], len(length)))) * (n > 0)
    first_upper = _CLASSES["upper"][data[starts]] if len(starts) else np.zeros(0, bool)
    uppers = np.append(0, np.cumsum(_CLASSES["upper"][data]))
    symbols = np.append(0, np.cumsum(_CLASSES["symbol"][data]))
    out["title_words"] = _sums(first_upper, firsts) / per_word
    out["caps_words"] = _sums((uppers[ends] - uppers[starts] >= 2), firsts) / per_word
    out["symbol_words"] = _sums((symbols[ends] - symbols[starts] >= 2), firsts) / per_word
    out["pipe_words"] = _sums(_CLASSES["pipe"][data[starts]] if len(starts) else first_upper, firsts) / per_word
    words = seg.segment_hashes(seg.lower_ascii(data), starts, ends, 11)
    same_row = row[1:] == row[:-1]
    out["adjacent"] = _sums(np.append(False, same_row & (words[1:] == words[:-1])) if len(words) else np.zeros(0), firsts) / per_word
    out["distinct"], out["top_word"] = _spread(words, row, firsts, per_word)
    pairs = words[1:] * np.uint64(3) + words[:-1] if len(words) else words
    inside = np.flatnonzero(same_row)
    pair_firsts = np.searchsorted(row[inside], np.arange(len(firsts)))
    out["distinct_pairs"], _ = _spread(pairs[inside], row[inside], pair_firsts, np.maximum(n - 1, 1))
    out["log_lines"] = np.log1p(_sums(data == 10, offsets))
    table = np.stack([out[s] for s in STATS], axis=1)
    table[n_bytes == 0] = 0
    return table


def _spread(keys: np.ndarray, row: np.ndarray, firsts: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row and its most frequent key, both as shares."""
    rows = len(firsts) - 1
    if not len(keys):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]))
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(k)))
    top = np.zeros(rows)
    np.maximum.at(top, r[at], counts)
    return np.bincount(r[at], minlength=rows) / per, top / per


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in seg.batches_of(batches, "_text", TASK_BYTES):
        table = text_statistics(*seg.text_bytes(batch.column("_text")))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), len(STATS)).cast(pa.list_(pa.float64()))
        keep = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], lists], [*[batch.schema.names[i] for i in keep], "stats"])


def document_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` and ``stats``, an array of doubles, of every row; a null text counts as empty."""
    kept = docs.select(*(keep or []), F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_measure, f"{fields}{', ' if fields else ''}stats array<double>")


class Model:
    """Scaling, random features, weights and calibration; a few thousand numbers."""

    def __init__(self, mean, sd, seed: int = 7, features: int = FEATURES):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = np.asarray(mean), np.asarray(sd)
        d = len(self.mean)
        self.w = rng.standard_normal((d, features)) / (WIDTH * np.sqrt(d))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.x = self.y = np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -6, 6)
        waves = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.hstack([waves, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.x, self.y)


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(batch.column("stats").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(batch.num_rows, -1)


def _equations(model: Model):
    """The sums of one partition: a row of the normal equations each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = model.features(_stats_of(batch))
                y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
                part = np.hstack([x.T @ x, (x.T @ y)[:, None]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    return run


def _add(pdf):
    import pandas as pd

    rows = sorted(tuple(r) for r in pdf["sums"])
    return pd.DataFrame({"i": [pdf["i"].iloc[0]], "sums": [np.sum(rows, axis=0).tolist()]})


def pool(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the share of ones on x: blocks' mean places and shares, in order."""
    blocks = []
    for a, b, c in zip(x * n, n, ones, strict=True):
        blocks.append([a, b, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([a / b for a, b, _ in blocks]), np.array([c / b for _, b, c in blocks])


def fit(labelled: DataFrame, seed: int = 7) -> Model | None:
    """Fit on rows of ``stats``, ``label`` (0 or 1) and ``fold``; the last fold calibrates, the others give the weights.

    Every labelled row counts. Partitions send sums: the normal equations are
    added up row by row in Spark, and what comes to the driver has a fixed size.
    """
    cols = [F.get("stats", F.lit(i)) for i in range(len(STATS))]
    got = labelled.agg(F.count("*"), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    if not got[0]:
        return None
    d = len(STATS)
    model = Model(got[1 : d + 1], [s if s > 1e-9 else 1.0 for s in got[d + 1 :]], seed)
    last = FOLDS - 1
    sums = labelled.where(F.col("fold") != last).select("stats", "label").mapInArrow(_equations(model), "i int, sums array<double>")
    # Sums of sums, so that no task adds up all partitions.
    sums = sums.groupBy("i", F.pmod(F.xxhash64("sums"), F.lit(64)).alias("salt")).applyInPandas(_add, "i int, sums array<double>")
    rows = sums.groupBy("i").applyInPandas(_add, "i int, sums array<double>").collect()
    if rows:
        m = np.array([r.sums for r in sorted(rows, key=lambda r: r.i)])
        a, b = m[:, :-1], m[:, -1]
        count = a[-1, -1]
        model.weights = np.linalg.solve(a + RIDGE * count / 100 * np.eye(len(a)), b)
    held = labelled.where(F.col("fold") == last)
    scored = held.select("stats", "label").mapInArrow(_score(model, ["label"], calibrated=False), "label int, score double")
    at = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.9999), (F.col("score") + 0.5) / 2)) * BINS).cast("int")
    hist = scored.groupBy(at.alias("bin")).agg(F.avg("score").alias("x"), F.count("*").alias("n"), F.sum("label").alias("ones")).collect()
    if hist:
        hist = sorted(hist, key=lambda r: r.bin)
        # One row of either label at the ends keeps scores off 0 and 1 and the line unbroken.
        x = np.array([-0.5, *[r.x for r in hist], 1.5])
        n = np.array([1, *[r.n for r in hist], 1])
        ones = np.array([0, *[r.ones for r in hist], 1])
        model.x, model.y = pool(x, n, ones)
    return model


def _score(model: Model, keep: list[str], calibrated: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _stats_of(batch)
            s = model.score(stats) if calibrated else model.raw(stats)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(s)], [*keep, "score"])

    return run


def fold_of(id_col: str):
    """A fold by the checksum of the id as text; rows without an id are in fold 0, which no label is taken from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0)).cast("int")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` ids with ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``, one row for each row.

    Labels other than 0 and 1 are ignored; of several labels of one document
    the smallest counts. Rows of fold 0 are held out. Without any label every
    score is 0.5. Null and empty texts are scored by their statistics, which are 0.
    """
    stats = cut_lineage(document_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", ["doc_id"]), "stats")
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    training = stats.withColumn("fold", fold_of("doc_id")).where("fold <> 0").join(known, "doc_id")
    model = fit(training) or Model(np.zeros(len(STATS)), np.ones(len(STATS)))
    scored = stats.mapInArrow(_score(model, ["doc_id"]), f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good, with their columns.

    The statistics are worked out with the row at hand, so nothing is joined;
    other columns ride along under any name, and null texts are scored as empty.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("label"))
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(fold_of("doc_id") != 0)
    training = document_statistics(ids.join(known, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label"), "text", ["doc_id", "label"])
    training = cut_lineage(training.withColumn("fold", fold_of("doc_id")), "training")
    model = fit(training)
    if model is None:
        return docs
    return docs.mapInArrow(_keep(model, text_col), docs.schema)


def _keep(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in seg.batches_of(batches, text_col, TASK_BYTES):
            score = model.score(text_statistics(*seg.text_bytes(batch.column(text_col))))
            yield batch.filter(pa.array(score >= THRESHOLD))

    return run
