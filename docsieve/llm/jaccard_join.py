"""Near duplicates by word shingles: adaptive multi-match prefixes, exact verification, connected components."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import segments as seg
from docsieve.llm.graph import components, more_links
from docsieve.session import cut_lineage, scratch_path

TASK_BYTES = 6 << 20
SHINGLE = 4
THRESHOLD = 85
# Counters of the frequency sketch, 2^20: four megabytes at any size of the corpus.
SKETCH_BITS = 20
_CHUNK = 1 << 14
# The longest lengthening of a prefix, and what a verification costs against reading one posting, per shingle.
MOST_MATCHES = 4
VERIFY = 1 / 512
# Pivots of a posting list in the second round; each later round takes as many times more.
PIVOTS = 16
# Documents held against one pivot in one task.
PER_TASK = 1000
# Bits of the filter that spares unconcerned documents the shuffle: one megabyte.
FILTER_BITS = 23
# Longs of a set's parity bits.
PARITY = 16

_SIG = "id bigint, d1 bigint, d2 bigint, n int, ell int, prefix array<bigint>, parity array<bigint>"
_SIG_SCHEMA = pa.schema([
    ("id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int32()), ("ell", pa.int32()), ("prefix", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))
])


def shingles(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles and the row of each; a text with fewer words has one shingle, its words."""
    data, offsets = seg.text_bytes(col)
    low = seg.lower_ascii(data)
    starts, ends, firsts = seg.word_bounds(low, offsets)
    words = seg.segment_hashes(low, starts, ends, 11)
    row = seg.rows_of(firsts)
    keys = seg.window_hashes(words, size, 11)
    inside = row[: len(keys)] == row[len(row) - len(keys) :] if len(keys) else np.zeros(0, bool)
    out, rows = [keys[inside]], [row[: len(keys)][inside]]
    counts = np.diff(firsts)
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            out.append(seg.window_hashes(words, k, 12)[firsts[short]] + np.uint64(k))
            rows.append(short)
    return np.concatenate(out), np.concatenate(rows)


def _cell(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count_cells(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in seg.batches_of(batches, "text", TASK_BYTES):
            total += np.bincount(_cell(shingles(batch.column("text"), size)[0]), minlength=len(total))
        if total.any():
            parts = total.reshape(-1, _CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts])], ["chunk", "counts"])

    return run


def _add_cells(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(zlib.decompress(x), np.int64) for x in group["counts"].to_pylist()], axis=0)
    return pa.table({"chunk": pa.array([group["chunk"][0].as_py()], pa.int32()), "counts": [zlib.compress(total.tobytes(), 1)]})


def frequency_sketch(rows: DataFrame, size: int) -> np.ndarray:
    """How often the shingles of each of 2^20 hash cells occur in all documents: a fixed size."""
    cells = rows.mapInArrow(_count_cells(size), "chunk int, counts binary")
    # Sums of sums, so that no task adds up the cells of all partitions.
    part = F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt")
    cells = cells.groupBy("chunk", part).applyInArrow(_add_cells, "chunk int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.int64).reshape(-1, _CHUNK)
    for r in cells.groupBy("chunk").applyInArrow(_add_cells, "chunk int, counts binary").collect():
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def _parity_bits(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> pa.Array:
    """A row's shingles flip one of 1,024 bits each; two rows' bits differ in at most as many places as their sets do."""
    bits = np.zeros(n_rows * PARITY, np.uint64)
    at = seg.FAMILIES[11].mix(keys ^ np.uint64(PARITY)) >> np.uint64(64 - 10)
    np.bitwise_xor.at(bits, rows * PARITY + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(np.arange(n_rows + 1) * PARITY, pa.int32()), pa.array(bits.view(np.int64)))


def _signatures(sketch: np.ndarray, size: int, threshold: int):
    load = sketch.mean()
    excess = np.maximum(sketch - load - 3 * np.sqrt(load), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in seg.batches_of(batches, "text", TASK_BYTES):
            keys, rows = shingles(batch.column("text"), size)
            # Rare shingles first, by the sketch; ties by hash, so that all documents agree.
            order = np.lexsort((keys, sketch[_cell(keys)], rows))
            keys, rows = keys[order], rows[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])) if len(keys) else np.zeros(0, bool)
            keys, rows = keys[new], rows[new]
            firsts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            n = np.diff(firsts)
            digests = []
            for seed in (11, 12):
                total = np.append(np.uint64(0), np.cumsum(seg.FAMILIES[seed].mix(keys * np.uint64(seed) + np.uint64(seed))))
                digests.append((total[firsts[1:]] - total[firsts[:-1]]).view(np.int64))
            least = -(-threshold * n // 100)
            cost = np.append(0, np.cumsum(excess[_cell(keys)]))
            lists = [np.minimum(n - least + m, n) for m in range(1, MOST_MATCHES + 1)]
            read = np.stack([cost[firsts[:-1] + p] - cost[firsts[:-1]] + p for p in lists])
            hits = cost[firsts[:-1] + lists[0]] - cost[firsts[:-1]]
            # A longer prefix reads more postings, and candidates must share more of them.
            total = read + VERIFY * n * hits / np.arange(1, MOST_MATCHES + 1)[:, None]
            ell = np.minimum(total.argmin(axis=0) + 1, np.maximum(least, 1))
            length = np.minimum(n - least + ell, n)
            upto = np.append(0, np.cumsum(length))
            flat = keys[np.repeat(firsts[:-1] - upto[:-1], length) + np.arange(upto[-1])].view(np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat))
            cols = [batch.column("id"), pa.array(digests[0]), pa.array(digests[1]), pa.array(n, pa.int32()), pa.array(ell, pa.int32()), prefix, _parity_bits(keys, rows, batch.num_rows)]
            yield pa.RecordBatch.from_arrays(cols, schema=_SIG_SCHEMA)

    return run


def only_ids(df: DataFrame, id_col: str, ids: DataFrame, other: str) -> DataFrame:
    """Most rows of ``df`` whose id is not in ``ids`` dropped before a join, by a bit per hashed id.

    The bits are built in Spark and have a fixed size, a megabyte in 256 rows;
    with very many ids the filter fills up and lets rows pass, never the reverse.
    """
    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS)) + 1

    bits = ids.select(place(other).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    rows = df.withColumn("_p", place(id_col)).withColumn("_bucket", F.bitmap_bucket_number("_p")).join(F.broadcast(bits), "_bucket")
    at = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.where(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0).drop("_p", "_bucket", "_bits")


_SETS = "pivot bigint, salt int, own boolean, id bigint, shingles binary"


def _sets(size: int):
    """The sorted distinct shingles of each asked document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in seg.batches_of(batches, "text", TASK_BYTES):
            keys, rows = shingles(batch.column("text"), size)
            order = np.lexsort((keys, rows))
            keys, rows = keys[order], rows[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])) if len(keys) else np.zeros(0, bool)
            keys, rows = keys[new], rows[new]
            firsts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            sets = pa.array([keys[a:b].tobytes() for a, b in zip(firsts[:-1], firsts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("pivot", "salt", "own", "id")] + [sets], ["pivot", "salt", "own", "id", "shingles"])

    return run


def _verify(threshold: int):
    """Hold the documents of a group against the group's pivot."""

    def run(group: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in group.filter(group["own"])["shingles"].to_pylist()]
        rest = group.filter(pa.compute.invert(group["own"]))
        found = []
        if own and rest.num_rows:
            sets = [np.frombuffer(x, np.uint64) for x in rest["shingles"].to_pylist()]
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            firsts = np.append(0, np.cumsum(sizes))
            for p in own:
                at = np.searchsorted(p, flat)
                hit = np.append(0, np.cumsum(p[np.minimum(at, len(p) - 1)] == flat)) if len(p) else np.zeros(len(flat) + 1, int)
                both = hit[firsts[1:]] - hit[firsts[:-1]]
                found.append((100 * both >= threshold * (sizes + len(p) - both)) & (both > 0))
        ok = np.any(found, axis=0) if found else np.zeros(rest.num_rows, bool)
        linked = rest.filter(pa.array(ok))
        return pa.table({"a": linked["pivot"], "b": linked["id"]})

    return run


def _links(docs: DataFrame, pairs: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (``p, y``) that are similar enough, by their whole sets.

    The documents of a pivot are dealt out over tasks of bounded size; the
    pivot's own set goes to each of them.
    """
    counts = pairs.groupBy("p").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("tasks"))
    asked = pairs.join(counts, "p").select(
        F.col("y").alias("id"), F.col("p").alias("pivot"), F.pmod(F.xxhash64("y"), F.col("tasks")).cast("int").alias("salt"), F.lit(False).alias("own")
    )
    pivots = counts.select(F.col("p").alias("id"), F.col("p").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), F.lit(True).alias("own"))
    asked = cut_lineage(asked.union(pivots), "asked")
    rows = only_ids(docs, "id", asked.select("id"), "id").join(asked, "id")
    sets = rows.select("pivot", "salt", "own", "id", "text").mapInArrow(_sets(size), _SETS)
    return sets.groupBy("pivot", "salt").applyInArrow(_verify(threshold), "a bigint, b bigint").distinct()


def _length(n: Column, ell: Column, threshold: int) -> Column:
    """The length of a prefix."""
    return F.least(n - F.ceil(n * threshold / 100).cast("int") + ell, n)


def _enough_matches(pairs: DataFrame, sig: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose prefixes share enough shingles to be similar at all.

    All shingles beyond a prefix come later in the common order, so the overlap
    is at most the shared prefix shingles and the longer rest; lengthening asks
    for as many shared shingles besides. ``seen`` is a lower bound from the
    postings; only pairs below their number are counted anew, on the prefixes.
    """
    overlap = F.ceil((F.col("n_p") + F.col("n_y")) * threshold / (100 + threshold)).cast("int")
    rest = F.greatest(*[F.col(f"n_{k}") - _length(F.col(f"n_{k}"), F.col(f"ell_{k}"), threshold) for k in ("p", "y")])
    pairs = pairs.withColumn("need", F.greatest(F.least("ell_p", "ell_y"), overlap - rest))
    sure = pairs.where(F.col("seen") >= F.col("need")).select("p", "y")
    open_ = pairs.where(F.col("seen") < F.col("need")).select("p", "y", "need")
    heads = only_ids(sig.select("id", "prefix"), "id", open_.select(F.explode(F.array("p", "y")).alias("id")), "id")
    left = heads.select(F.col("id").alias("p"), F.col("prefix").alias("_left"))
    right = heads.select(F.col("id").alias("y"), F.col("prefix").alias("_right"))
    counted = open_.join(left, "p").join(right, "y").where(F.size(F.array_intersect("_left", "_right")) >= F.col("need"))
    return sure.union(counted.select("p", "y")).distinct()


def _met(active: DataFrame, threshold: int) -> DataFrame:
    """Members of a posting list with its pivot, where the pair can be similar by size and place.

    The overlap is at least 2t / (1 + t) times the smaller set, so the smaller
    one must hold the shared shingle in the short part of its prefix.
    """
    n, m = F.col("n"), F.col("pivot.n")
    placed = F.when(n < m, F.col("short")).when(n > m, F.col("pivot.short")).otherwise(F.col("short") & F.col("pivot.short"))
    met = active.where((F.col("rep") != F.col("pivot.rep")) & placed & (F.least(n, m) * 100 >= F.greatest(n, m) * threshold))
    one = F.struct("rep", "n", "ell")
    two = F.struct(F.col("pivot.rep").alias("rep"), m.alias("n"), F.col("pivot.ell").alias("ell"))
    pair = met.select(F.least(one, two).alias("p"), F.greatest(one, two).alias("y"), "token")
    pair = pair.groupBy(F.col("p.rep").alias("p"), F.col("y.rep").alias("y")).agg(
        F.count("*").alias("seen"), *[F.min(f"{k}.{c}").alias(f"{c}_{k}") for k in ("p", "y") for c in ("n", "ell")]
    )
    return pair


def _parity_allows(threshold: int) -> Column:
    """Whether a posting and its pivot can be similar by their parity bits: false only where the sets differ in too much."""
    n, m = F.col("n"), F.col("pivot.n")
    differ = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("pivot.parity")[i])) for i in range(PARITY)), F.lit(0))
    return F.coalesce(differ <= n + m - 2 * F.ceil((n + m) * threshold / (100 + threshold)), F.lit(True))


class _Pairs:
    """Pairs written round by round and read as one table, so that plans do not grow with the rounds."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def add(self, pairs: DataFrame) -> DataFrame:
        self.paths.append(scratch_path(self.spark, "pairs"))
        pairs.write.parquet(self.paths[-1])
        return self.spark.read.schema(pairs.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema("p bigint, y bigint").parquet(*self.paths)


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD
) -> DataFrame:
    """``id, n_shingles, component_id`` of every row: components under Jaccard similarity of word shingles.

    Two documents link when 100 * |A and B| >= threshold * |A or B|, with A-Z
    lower-cased. Copies (equal sets) are one class. Every class has a prefix:
    its rarest shingles by a frequency sketch, lengthened by what its candidates
    would cost; two similar classes share as many prefix shingles as the shorter
    lengthening asks for. Each posting list is held against its smallest
    member, then, for members that are not yet in one component, against more
    and more pivots, until no list has an untested pair left; so near copies by
    the thousands cost one comparison each, and no link between components is
    missed.

    Null or empty texts have no shingles and link with nothing, rows without an
    id neither (their component is null). Rows that share an id are each placed
    by their own text; classes named by one smallest id count as one.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sketch = frequency_sketch(rows.select("text"), size)
    sig = cut_lineage(rows.mapInArrow(_signatures(sketch, size, threshold), _SIG), "signatures")
    usable = sig.where("n > 0 and id is not null")
    classes = usable.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.first("ell").alias("ell"), F.first("prefix").alias("prefix"))
    short = F.col("n") - F.ceil(F.col("n") * (2 * threshold) / (100 + threshold)).cast("int") + F.col("ell")
    postings = classes.select("rep", "n", "ell", short.alias("_upto"), F.posexplode("prefix").alias("_at", "token"))
    postings = postings.select("token", "rep", "n", "ell", (F.col("_at") < F.col("_upto")).alias("short"))
    one = F.struct("rep", "n", "ell", "short")
    first = postings.groupBy("token").agg(F.count("*").alias("m"), F.max("short").alias("any"), F.min(one).alias("pivot"))
    active = cut_lineage(postings.join(first.where("m > 1 and any").drop("m", "any"), "token"), "postings")
    tested = _Pairs(docs.sparkSession)
    pairs = tested.add(_met(active, threshold))
    roots = components(_links(rows, _enough_matches(pairs, usable, threshold), size, threshold))
    active = active.where(F.col("rep") != F.col("pivot.rep")).drop("pivot")
    # From here on postings carry the parity bits of their sets: few lists are left, but these meet many pivots.
    # An id that several texts share has none and is never ruled out by them.
    text_of = F.struct("d1", "d2", "n")
    bits = usable.groupBy(F.col("id").alias("rep")).agg(F.when(F.min(text_of) == F.max(text_of), F.first("parity")).alias("parity"))
    pivots = PIVOTS
    while True:
        # Lists whose members lie in several components are still open.
        placed = active.join(roots, F.col("rep") == F.col("node"), "left").drop("node").withColumn("comp", F.coalesce("root", "rep")).drop("root")
        mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("short").alias("any")).where("lo <> hi and any")
        active = placed.join(mixed.select("token"), "token")
        if pivots == PIVOTS:
            active = active.join(bits, "rep")
        active = cut_lineage(active, "postings")
        if active.isEmpty():
            break
        spread = F.pmod(F.xxhash64("rep"), F.lit(pivots))
        chosen = active.groupBy("token", spread.alias("s")).agg(F.min(F.struct("rep", "n", "ell", "short", "comp", "parity")).alias("pivot")).drop("s")
        chosen = cut_lineage(chosen, "pivots")
        new = _met(active.join(chosen, "token").where((F.col("comp") != F.col("pivot.comp")) & _parity_allows(threshold)), threshold)
        new = tested.add(new.join(tested.all(), ["p", "y"], "left_anti"))
        roots = more_links(roots, _links(rows, _enough_matches(new, usable, threshold), size, threshold))
        gone = chosen.select("token", F.col("pivot.rep").alias("rep"))
        active = active.join(gone, ["token", "rep"], "left_anti").drop("comp")
        pivots *= PIVOTS
    members = usable.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    placed = members.join(roots, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.col("n").alias("_n"), F.coalesce("root", "rep").alias("root"))
    by_class = sig.select("id", "d1", "d2", "n").join(
        placed, (sig["d1"] == placed["d1"]) & (sig["d2"] == placed["d2"]) & (sig["n"] == F.col("_n")) & sig["id"].isNotNull(), "left"
    )
    return by_class.select(
        F.col("id"), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("root", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, the one with the smallest id, and every row without an id."""
    groups = similar_groups(docs, id_col, text_col, size, threshold)
    lost = groups.where(F.col("component_id") != F.col("id")).select(F.col("id").alias("_lost")).distinct()
    return docs.join(lost, docs[id_col] == lost["_lost"], "left_anti")
