"""Streams of many files, in time order and in several micro-batches, equal the batch result."""

import pytest
from pyspark.sql import functions as F

from docsieve.operators import relational as rel
from docsieve.streaming import jobs as st


@pytest.fixture(scope="module")
def files(spark, sf, tmp_path_factory):
    """The events as five files, written one after another in time order."""
    root = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{sf}/events.parquet")
    step = events.count() // 5 + 1
    for i in range(5):
        events.where((F.col("event_id") >= i * step) & (F.col("event_id") < (i + 1) * step)).coalesce(1).write.mode("append").parquet(str(root))
    return str(root)


@pytest.fixture
def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture
def stream(spark, files, events):
    schema = spark.read.parquet(files).schema
    return st.read_stream(spark, files, schema, files_per_batch=1)


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_totals_in_update_mode(stream, events):
    got = st.run_available_now(st.running_totals(stream, ["event_type"], "event_id"), "t", "update", ["event_type"])
    assert rows(got) == rows(st.running_totals(events, ["event_type"], "event_id"))


def test_windows_in_complete_mode(stream, events):
    aggs = [F.count("*").alias("n")]
    got = st.run_available_now(st.windowed(stream, "ts", "1 hour", "6 hours", ["event_type"], aggs, "1 hour"), "w", "complete")
    assert rows(got) == rows(st.windowed(events, "ts", "1 hour", "6 hours", ["event_type"], aggs, "1 hour"))


def test_sessions_closed_ones(stream, events):
    aggs = [F.count("*").alias("n")]
    got = st.run_available_now(st.sessions(stream, "ts", "1 hour", "30 minutes", ["user_id"], aggs), "s", "append")
    end = events.agg(F.max("ts").alias("m")).first().m
    want = st.sessions(events, "ts", "1 hour", "30 minutes", ["user_id"], aggs).where(
        F.col("window_end") <= F.lit(end) - F.expr("interval 1 hour"))
    assert rows(got) == rows(want) and got.count() > 0


def test_dedup_over_batches(spark, stream, events, files):
    again = st.read_stream(spark, files, spark.read.parquet(files).schema, files_per_batch=1)
    got = st.run_available_now(st.dedup(stream.unionByName(again), "ts", ["event_id"], "10 days"), "d", "append")
    assert rows(got.select("event_id")) == rows(events.select("event_id"))


def test_interval_join(stream, events):
    def pair(df):
        v = df.where("event_type = 'view'").select(F.col("event_id").alias("v"), F.col("user_id").alias("vu"), F.col("ts").alias("vt"))
        c = df.where("event_type = 'click'").select(F.col("event_id").alias("c"), F.col("user_id").alias("cu"), F.col("ts").alias("ct"))
        return st.interval_join(v, c, "vt", "ct", F.col("vu") == F.col("cu"), "12 hours", 36000).select("v", "c")

    got = st.run_available_now(pair(stream), "j", "append")
    assert rows(got) == rows(pair(events)) and got.count() > 0


def test_outliers_carry_over_batches(stream, events):
    cols = ["event_id", "mean", "std", "is_outlier"]
    near = lambda df: df.select("event_id", F.round("mean", 6).alias("m"), F.round("std", 6).alias("s"), "is_outlier")
    got = st.stream_outliers(stream.select("event_id", "event_type", "ts", "value"), "o", "event_type", "ts", "event_id", "value", 30)
    want = rel.rolling_outliers(events, "event_type", ["ts", "event_id"], F.to_date("ts"), "value", 30)
    assert rows(near(got.select(*cols))) == rows(near(want.select(*cols)))


def test_apply_changes_over_batches(spark, stream, events):
    empty = spark.createDataFrame([], "user_id bigint, event_id bigint, value double")
    got = st.apply_changes(stream, "c", empty, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", {"all": lambda b: b})["all"]
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value", "event_type"), F.struct("ts", "event_id")).alias("r"))
    want = last.where("r.event_type <> 'error'").select("user_id", "r.event_id", "r.value")
    assert rows(got) == rows(want)


def test_fan_out_and_backfill(spark, stream, events):
    sinks = st.fan_out(stream, "f", {"raw": lambda b: b, "bad": lambda b: b.where("event_type = 'error'")})
    assert sinks.read("raw").count() == events.count()
    assert sinks.read("bad").count() == events.where("event_type = 'error'").count()
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k long, name string")
    facts = spark.createDataFrame([(1, None), (1, "old"), (3, None)], "id long, name string")
    assert rows(st.backfill(facts, dim, "id", "k", ["name"])) == sorted(["Row(id=1, name='a')", "Row(id=1, name='old')", "Row(id=3, name=None)"])
    assert st.trigger() == {"availableNow": True} and st.trigger("1 minute") == {"processingTime": "1 minute"}


def growing(spark, tmp_path, name, batches):
    """A folder that gets one file after the other."""
    source = f"{tmp_path}/{name}"

    def add(i):
        spark.createDataFrame(batches[i], "k string, at int, v int").coalesce(1).write.mode("append").parquet(source)
        return st.read_stream(spark, source, spark.createDataFrame([], "k string, at int, v int").schema)

    return add


def test_runs_go_on_and_read_only_what_is_new(spark, tmp_path):
    add = growing(spark, tmp_path, "in", [[("a", 1, 1), ("b", 1, 2)], [("a", 2, 5)], [("c", 3, 7), ("a", 3, 1)]])
    root, read = f"{tmp_path}/root", []

    def counted(batch, batch_id):
        read.append((batch_id, sorted(r.v for r in batch.collect())))

    for i in range(3):
        st.run_batches(add(i), root, counted)
    assert read == [(0, [1, 2]), (1, [5]), (2, [1, 7])]


def test_totals_over_runs_equal_batch(spark, tmp_path):
    batches = [[("a", 1, 1), ("b", 1, 2)], [("a", 2, 5)], [("c", 3, 7), ("a", 3, 1)]]
    for mode in ("update", "complete"):
        add = growing(spark, tmp_path, mode, batches)
        for i in range(3):
            out = st.run_available_now(st.running_totals(add(i), ["k"], "v"), "t", mode, ["k"], root=f"{tmp_path}/{mode}-root")
            rows = [r for b in batches[: i + 1] for r in b]
            assert {(r.k, r.n, r.total) for r in out.collect()} == {(k, sum(x[0] == k for x in rows), sum(x[2] for x in rows if x[0] == k)) for k in {x[0] for x in rows}}


def test_changes_go_on_from_the_manifest(spark, tmp_path):
    empty = spark.createDataFrame([], "k string, v int")
    add = growing(spark, tmp_path, "cdc", [[("a", 1, 1), ("b", 1, 2)], [("a", 2, -1), ("c", 2, 3)], [("b", 3, 9)]])
    views = {"all": lambda b: b, "odd": lambda b: b.withColumn("_gone", F.col("_gone") | (F.col("v") % 2 == 0))}
    want = [{("a", 1), ("b", 2)}, {("b", 2), ("c", 3)}, {("b", 9), ("c", 3)}]
    root = f"{tmp_path}/cdc-root"
    for i in range(3):
        out = st.apply_changes(add(i), "cdc", empty, ["k"], ["at"], F.col("v") < 0, views, root)
        assert {tuple(r) for r in out["all"].collect()} == want[i]
        assert {tuple(r) for r in out["odd"].collect()} == {x for x in want[i] if x[1] % 2}
    versions = st.Versions(spark, root, empty.schema)
    # A version that was not committed is not read, and does not change what follows.
    versions.write("all", empty, 7)
    assert versions.newest() == 2 and versions.newest(2) == 1 and versions.newest(0) is None


def test_outliers_go_on(spark, tmp_path):
    rows = [("k", i, 1000 if i == 40 else i % 3) for i in range(60)]
    add = growing(spark, tmp_path, "out", [rows[:25], rows[25:45], rows[45:]])
    for i in range(3):
        s = add(i).withColumn("ts", F.timestamp_seconds("at"))
        out = st.stream_outliers(s, "o", "k", "ts", "at", "v", 20, 3.0, root=f"{tmp_path}/out-root")
    got = {r.at: (round(r["mean"], 9), r.is_outlier) for r in out.collect()}
    assert len(got) == 60 and [a for a, (_, o) in got.items() if o] == [40]
    assert got[30][0] == round(sum(i % 3 for i in range(10, 31)) / 21, 9)


def test_interval_trigger_keeps_on(spark, tmp_path):
    add = growing(spark, tmp_path, "live", [[("a", 1, 1)], [("b", 2, 2)]])
    seen = []
    q = st.start_batches(add(0), f"{tmp_path}/live-root", lambda b, i: seen.extend(r.k for r in b.collect()), "500 milliseconds")
    try:
        q.processAllAvailable()
        add(1)
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == ["a", "b"]
