import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from docsieve.operators import scale


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False), st.just(7.0))), min_size=1, max_size=60))
def test_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in scale.exact_quantiles(df, ["g"], "v", [0.0, 0.5, 0.95], ["lo", "mid", "hi"]).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        want = np.quantile(vs, [0.0, 0.5, 0.95])
        assert [got[g].lo, got[g].mid, got[g].hi] == pytest.approx(list(want), rel=1e-9, abs=1e-9)


def test_quantiles_without_groups(spark):
    df = spark.range(1001).select((F.col("id") % 1000).cast("double").alias("v"))
    r = scale.exact_quantiles(df, [], "v", [0.5, 0.99]).first()
    assert (r.p50, r.p99) == (np.quantile(np.arange(1001) % 1000, 0.5), np.quantile(np.arange(1001) % 1000, 0.99))


EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.0, -1.0, 1 + 2**-52, 2.0, 2 - 2**-52, 3.5, 1e300, -1e300, 1.7976931348623157e308, 1.7e18, 1.7e18 + 256, 0.1, 1 / 3]


def test_ordered_bits_keep_order_and_value(spark):
    rng = np.random.default_rng(1)
    values = [*EDGES, float("inf"), float("-inf"), float("nan"), *(rng.standard_normal(3000) * 10.0 ** rng.integers(-320, 308, 3000)).tolist(), *(2.0 ** np.arange(-1074, 1024)).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", scale.ordered_bits(F.col("v"))).withColumn("back", scale.from_ordered_bits(F.col("k")))
    rows = df.collect()
    assert all(r.back == r.v or (np.isnan(r.v) and np.isnan(r.back)) for r in rows)
    ranked = sorted((r for r in rows if not np.isnan(r.v)), key=lambda r: r.v)
    assert all((a.k < b.k) == (a.v < b.v) and (a.k == b.k) == (a.v == b.v) for a, b in zip(ranked, ranked[1:], strict=False))
    assert max(r.k for r in rows) == next(r.k for r in rows if np.isnan(r.v))


@pytest.mark.parametrize("values", [
    [1.0, 2.0, float("nan")], [float("nan")] * 3, [float("inf"), float("-inf"), 0.0], EDGES, [5e-324 * i for i in range(50)],
    [1.7e9 + i / 1e6 for i in range(500)], [1e308, -1e308, 1e-308], [7.0] * 300 + [8.0],
])
def test_quantiles_of_hard_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = list(scale.exact_quantiles(df, [], "v", probs).first())
    order = sorted(values, key=lambda v: (np.isnan(v), 0.0 if np.isnan(v) else v))
    for p, g in zip(probs, got, strict=True):
        at = (len(order) - 1) * p
        lo, hi = order[int(np.floor(at))], order[int(np.ceil(at))]
        want = lo if lo == hi else lo + (hi - lo) * (at - np.floor(at))
        assert g == want or (np.isnan(g) and np.isnan(want)), (p, g, want)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows; null is a key too."""
    k = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 20).cast("string")))
    return spark.range(900).select("id", k.alias("k"), (F.col("id") * 7 % 11).alias("v"))


def test_running_sums_in_slices(spark, skewed):
    fine = F.floor(F.col("id") / 40)
    plain = scale.running(skewed, ["k"], ["id"], {"s": F.col("v")}, fine)
    sliced = scale.running(skewed, ["k"], ["id"], {"s": F.col("v")}, fine)
    assert sorted(map(str, plain.select("id", "s").collect())) == sorted(map(str, sliced.select("id", "s").collect()))


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbours_in_slices(spark, skewed, ahead):
    cut = skewed.withColumn("_slice", F.floor(F.col("id") / 40))
    got = scale.neighbours_in_slices(cut, ["k"], "_slice", ["id"], ["id", "v"], ahead)
    name = "next" if ahead else "prev"
    w = Window.partitionBy("k").orderBy("id")
    shift = F.lead if ahead else F.lag
    want = skewed.select("id", shift("id").over(w).alias(f"{name}_id"), shift("v").over(w).alias(f"{name}_v"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k")).repartition(7)
    rows = scale.global_rank(df, ["k"]).collect()
    assert all(r["_rank"] == r.k and r["_total"] == 500 for r in rows) and len(rows) == 500


def test_side_by_side(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3)], "k string, b int")
    assert {(r.k, r.a, r.b) for r in scale.side_by_side([a, b], ["k"]).collect()} == {(None, 1, 3), ("x", 2, None)}


def test_scratch_needs_a_shared_folder(spark):
    from docsieve import session

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        session.scratch_root(Cluster)
    Cluster.conf.get = staticmethod(lambda key, default: "hdfs://shared/ckpt/")
    assert session.scratch_root(Cluster) == "hdfs://shared/ckpt"
