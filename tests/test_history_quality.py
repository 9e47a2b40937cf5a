import itertools
import random
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docsieve.operators import history as hi
from docsieve.operators import quality as qu
from docsieve.operators import relational as rel


def changes(spark):
    rows = [("k", 1, "a", False), ("k", 2, "a", False), ("k", 3, "b", False), ("k", 4, None, False), ("k", 5, None, True), ("k", 6, "a", False),
            ("m", 1, "x", True), (None, 1, "n", False), ("z", 2, "p", False), ("z", 2, "q", False)]
    return spark.createDataFrame([(k, i, v, f"2024-01-{d:02d}", g) for i, (k, d, v, g) in enumerate(rows)], "k string, tie int, v string, d string, gone boolean").withColumn(
        "at", F.col("d").cast("timestamp_ntz"))


@pytest.mark.parametrize("slice_of", [None, F.to_date])
def test_scd2(spark, slice_of):
    out = hi.scd2(changes(spark), ["k"], "at", "tie", ["v"], F.col("gone"), slice_of and slice_of("start_at"))
    got = sorted(((r.k or "~", r.v, r.start_at.day, r.end_at.day if r.end_at else None) for r in out.collect()), key=str)
    assert got == sorted([("k", "a", 1, 3), ("k", "b", 3, 4), ("k", None, 4, 5), ("k", "a", 6, None), ("~", "n", 1, None), ("z", "p", 2, 2), ("z", "q", 2, None)], key=str)
    assert {r.k for r in hi.current(out).collect()} == {"k", None, "z"}
    assert {r.v for r in hi.as_of(out, F.lit("2024-01-03 12:00:00").cast("timestamp_ntz")).where("k = 'k'").collect()} == {"b"}


def test_scd1_and_merge(spark):
    assert {(r.k, r.v) for r in hi.scd1(changes(spark), ["k"], ["at", "tie"], F.col("gone")).collect()} == {("k", "a"), (None, "n"), ("z", "q")}
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    s = spark.createDataFrame([(1, "A", "U"), (2, None, "D"), (3, "n", "U"), (None, "C", "U")], "id int, v string, op string")
    assert {tuple(r) for r in hi.merge_upsert(t, s, ["id"], F.col("op") == "D").collect()} == {(1, "A"), (3, "n"), (None, "C")}


def test_join_as_of(spark):
    h = spark.createDataFrame([("k", "a", "2023-11-05", "2024-02-10"), ("k", "b", "2024-02-10", None)], "k string, v string, s string, e string").select(
        "k", "v", F.col("s").cast("timestamp_ntz").alias("start_at"), F.col("e").cast("timestamp_ntz").alias("end_at"))
    f = spark.createDataFrame([(1, "k", "2023-11-01"), (2, "k", "2024-02-09"), (3, "k", "2024-02-10"), (4, "k", "2025-07-01"), (5, "x", "2024-01-01")], "id int, k string, d string").select(
        "id", "k", F.col("d").cast("timestamp_ntz").alias("seen"))
    assert {r.id: r.v for r in hi.join_as_of(f, h, ["k"], "seen").collect()} == {1: None, 2: "a", 3: "b", 4: "b", 5: None}


def test_join_as_of_over_many_ranges(spark):
    """One key in all ranges, keys that end at an edge, facts before and after, ties, nulls and a fact in 9999."""
    rng = random.Random(7)
    versions, facts = [], []
    for k in ["hot", *[f"k{i}" for i in range(30)], None]:
        at = 0
        for n in range(400 if k == "hot" else rng.randrange(4)):
            start, at = at, at + rng.randrange(0, 40)
            versions.append((k, f"{k}-{n}", start, None if rng.random() < 0.02 and k != "hot" else at))
    for i in range(3000):
        facts.append((i, rng.choice(["hot"] * 3 + [f"k{i}" for i in range(32)] + [None]), rng.choice([None, -5, rng.randrange(9000), 250_000_000])))
    stamp = lambda c: F.timestamp_add("MINUTE", F.col(c), F.lit("2020-01-01").cast("timestamp_ntz"))
    h = spark.createDataFrame(versions, "k string, v string, s int, e int").select("k", "v", stamp("s").alias("start_at"), stamp("e").alias("end_at"))
    f = spark.createDataFrame(facts, "id int, k string, m int").select("id", "k", stamp("m").alias("seen"))
    want = {}
    for i, k, m in facts:
        fit = [v for v in versions if k is not None and m is not None and v[0] == k and v[2] <= m]
        last = max(fit, key=lambda v: (v[2], v[3] is None, v[3] or 0), default=None)
        want[i] = last[1] if last and (last[3] is None or last[3] > m) else None
    for parts in (4, 13):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            out = hi.join_as_of(f, h, ["k"], "seen")
            assert {r.id: r.v for r in out.collect()} == want and out.count() == len(facts)
            assert {r.id for r in hi.join_as_of(f, h, ["k"], "seen", "inner").collect()} == {i for i, v in want.items() if v}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trailing_distinct(spark):
    days = [("2024-01-01", "a"), ("2024-01-01", "b"), ("2024-01-02", "a"), ("2024-01-04", "c"), ("2024-01-09", "a")]
    df = spark.createDataFrame(days, "d string, v string")
    got = {str(r.day): r.distinct_values for r in hi.trailing_distinct(df, "d", "v", 3).collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 2, "2024-01-04": 2, "2024-01-09": 1}


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize(("distance", "score"), [(1, 0.8), (2, 0.0), (2, 0.7), (3, 0.5)])
def test_fuzzy_join_of_random_words(spark, distance, score):
    rng = random.Random(distance)
    word = lambda: "".join(rng.choice("aab\u00e9😀") for _ in range(rng.randrange(12)))
    a, b = [word() for _ in range(150)], [word() for _ in range(150)]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "w string")
    got = {(r.left_value, r.right_value): r.distance for r in rel.fuzzy_join(df(a), df(b), "w", "w", distance, score).collect()}
    want = {}
    for x in set(a):
        for y in set(b):
            d = lev(x, y)
            if d <= distance and 1 - d / max(len(x), len(y), 1) >= score:
                want[x, y] = d
    assert got == want


def test_fuzzy_join_around_the_short_length(spark, monkeypatch):
    monkeypatch.setattr(rel, "SHORT", 6)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(3, 11)))
    a, b = [word() for _ in range(120)], [word() for _ in range(120)]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "w string")
    got = {(r.left_value, r.right_value): r.distance for r in rel.fuzzy_join(df(a), df(b), "w", "w", 2, 0.6).collect()}
    want = {}
    for x in set(a):
        for y in set(b):
            d = lev(x, y)
            if d <= 2 and 1 - d / max(len(x), len(y)) >= 0.6:
                want[x, y] = d
    assert got == want


def test_fuzzy_join_of_long_tokens(spark):
    base = "".join(random.Random(1).choice("abcdef") for _ in range(8000))
    a = [base, base[:4000]]
    b = [base[:3999] + "x" + base[4000:], base[1:], base + "yz", base[:2000] + base[2001:4000], "x" * 8000]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "w string")
    start = time.time()
    got = {(a.index(r.left_value), b.index(r.right_value), r.distance) for r in rel.fuzzy_join(df(a), df(b), "w", "w", 2, 0.9).collect()}
    assert got == {(0, 0, 1), (0, 1, 1), (0, 2, 2), (1, 3, 1)}
    assert time.time() - start < 20


@pytest.mark.parametrize("distance", [1, 2])
def test_fuzzy_join(spark, distance):
    a = ["".join(p) for p in itertools.product("ab", repeat=3)] + ["é", "", "abab", "abab"]
    b = ["".join(p) for p in itertools.product("ac", repeat=3)] + ["ab", "x", "aabab", None]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "w string")
    got = {(r.left_value, r.right_value, r.distance) for r in rel.fuzzy_join(df(a), df(b), "w", "w", distance).collect()}
    assert got == {(x, y, lev(x, y)) for x in a for y in b if y is not None and lev(x, y) <= distance}


def test_hierarchy(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, 8)], "node int, parent int")
    assert {(r.node, r.depth) for r in rel.hierarchy(nodes, ["node"], ["parent"]).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert rel.hierarchy(nodes, ["node"], ["parent"], 1).count() == 2


def test_hierarchy_of_many_levels(spark):
    rows = [(0, None), *[(i, i - 1) for i in range(1, 1000)], *[(1000 + i, i % 7) for i in range(500)], (5000, 4999), (5001, 5000), (None, 999)]
    nodes = spark.createDataFrame(rows, "node int, parent int")
    got = {(r.node, r.depth) for r in rel.hierarchy(nodes, ["node"], ["parent"]).collect()}
    assert got == {*((i, i) for i in range(1000)), *((1000 + i, i % 7 + 1) for i in range(500)), (None, 1000)}
    assert {r.depth for r in rel.hierarchy(nodes, ["node"], ["parent"], 300).collect()} == set(range(301))


def test_hierarchy_with_a_cycle(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 5), (5, 3)], "node int, parent int")
    with pytest.raises(ValueError, match="cycle"):
        rel.hierarchy(nodes, ["node"], ["parent"])
    assert {r.node for r in rel.hierarchy(nodes, ["node"], ["parent"], 8).collect()} == {1, 2}


@pytest.mark.parametrize("block", [10_000, 25])
def test_rolling_outliers(spark, block):
    df = spark.range(60).select("id", F.lit("k").alias("k"), F.when(F.col("id") == 40, 1000.0).otherwise(F.col("id") % 3).cast("double").alias("v"))
    out = rel.rolling_outliers(df, "k", ["id"], F.floor(F.col("id") / 7), "v", 20, 3.0, block).orderBy("id").collect()
    assert [r.id for r in out if r.is_outlier] == [40] and len(out) == 60
    assert out[30].mean == pytest.approx(sum(i % 3 for i in range(10, 31)) / 21)


def test_faults_and_expectations(spark):
    ids = spark.range(2000)
    masters = qu.master_table(spark, 50)
    child = qu.child_table(ids, "id", masters, 50)
    assert child.where("customer_id is null").count() == 0 and child.where("amount <= 0").count() == 0
    shares = {"null_key": 0.05, "bad_amount": 0.1, "orphan": 0.1}
    bad = qu.inject_faults(child, qu.uniform(F.col("order_idx"), 1), shares, "customer_id", "amount", F.lit("CUST-nobody"))
    got = {r.issue: r.rows for r in qu.detect_faults(bad, "customer_id", "amount", masters, "customer_id").collect()}
    for k, share in shares.items():
        assert abs(got[k] / 2000 - share) < 0.03
    rules = {"has_key": F.col("customer_id").isNotNull(), "positive": F.col("amount") > 0}
    counts = {r.rule: r.failed for r in qu.expectation_counts(bad, rules).collect()}
    assert counts == {"has_key": got["null_key"], "positive": got["bad_amount"]}
    assert qu.drop_failing(bad, rules).count() == 2000 - got["null_key"] - got["bad_amount"]
    assert qu.fail_on(child, rules).count() == 2000
    with pytest.raises(PySparkException):
        qu.fail_on(bad, rules).count()


def test_rescue(spark):
    df = spark.createDataFrame([('{"k": 1}',), ('{"k": "x"}',), ("junk",), (None,)], "raw string")
    got = [(r.parsed.k if r.parsed else None, r.rescued) for r in qu.parse_or_rescue(df, "raw", "k bigint").collect()]
    assert got == [(1, None), (None, '{"k": "x"}'), (None, "junk"), (None, None)]
