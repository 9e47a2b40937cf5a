"""The quality query on held-out labels, packing against the tokenizer, the attention head against itself switched off."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docsieve.llm import line_dedup, lm, mixing, packing, queries
from docsieve.llm.subwords import default_vocabulary, subwords

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op3_quality_classifier(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).column("doc_id").to_pylist()
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if got[r["doc_id"]].held_out]
    assert len(held) > 20
    assert np.mean([got[r["doc_id"]].predicted == r["quality"] for r in held]) >= 0.95
    order = sorted(held, key=lambda r: got[r["doc_id"]].score)
    good = [i for i, r in enumerate(order) if r["quality"] == 1]
    bad = len(order) - len(good)
    if good and bad:  # the area under the curve
        assert (sum(good) - len(good) * (len(good) - 1) / 2) / (len(good) * bad) >= 0.97


def test_packing_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    got, places = defaultdict(list), defaultdict(list)
    for r in queries.op5_packing(spark, SF).collect():
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert set(got) == {d["doc_id"] for d in docs}
    total = 0
    for d in docs:
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        pieces = sorted(got[d["doc_id"]], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in pieces] == [(i, 2048 * i) for i in range(-(-len(ids) // 2048))]
        for r in pieces:
            cut = ids[r.start : r.start + 2048]
            assert r.length == len(cut) and r.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-total // 2048) + 1


def test_search_runs_to_its_end():
    """No move or exchange is left between two underfull bins."""
    rng = np.random.default_rng(2)
    for _ in range(10):
        sizes = rng.integers(20, 50, 200)
        bins = packing.local_search(sizes, np.arange(200) // 2, 100)
        fill = np.bincount(bins, weights=sizes).astype(int)
        for a in range(200):
            for b in np.flatnonzero((fill < 100) & (fill >= fill[bins[a]])):
                assert b == bins[a] or fill[b] + sizes[a] > 100 or len(fill) <= -(-sizes.sum() // 100)


def test_attention_head_is_better_than_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2).alias("held_out"), "text")
    encoded = rows.mapInArrow(lm._encode(default_vocabulary()), ", ".join(f"{c} binary" for c in lm._BLOCK)).persist()
    net = lm.fit(encoded)
    encoded.unpersist()
    held = [r.text for r in rows.where("held_out").collect()]
    ids, firsts = subwords(default_vocabulary()).documents(pa.array(held), 0)
    ids = ids.astype(np.int64)
    with_head = net.scores(ids, firsts).sum()
    net.p["out"][:] = 0
    without = net.scores(ids, firsts).sum()
    assert with_head > without


def test_vocabulary_of_another_size_is_refused(monkeypatch):
    monkeypatch.setattr(lm, "_IDS", 1000)
    with pytest.raises(ValueError, match="at most 1000"):
        lm.check_vocabulary(default_vocabulary())


CLASHING = ["_keep", "_fp", "_ofp", "_id", "_n", "_times", "id", "keep", "c0", "c1"]


def test_stages_keep_columns_of_any_name(spark):
    line = "a line that many documents of the table share"
    rows = [(i, f"own {i} words here\n{line}" if i else None, "en", f"s{i % 2}", 5, *[f"{n}{i}" for n in CLASHING]) for i in range(8)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in CLASHING)
    docs = spark.createDataFrame(rows, schema)
    for out in (line_dedup.without_lines(docs), mixing.repeat_taken(docs)):
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in CLASHING)
    lines = {r.doc_id: r.text for r in line_dedup.without_lines(docs).collect()}
    assert lines == {0: None, **{i: f"own {i} words here" for i in range(1, 7)}, 7: f"own 7 words here\n{line}"}
