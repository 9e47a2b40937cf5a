from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docsieve.session import ship_package
from docsieve.sources import time_range as tr
from docsieve.streaming import jobs as st


def test_slices_cut_at_whole_steps():
    day = timedelta(days=1)
    got = tr.slices(datetime(2024, 1, 1, 12), datetime(2024, 1, 3, 6), day)
    assert [(s.start, s.end) for s in got] == [
        (datetime(2024, 1, 1, 12), datetime(2024, 1, 2)), (datetime(2024, 1, 2), datetime(2024, 1, 3)), (datetime(2024, 1, 3), datetime(2024, 1, 3, 6))
    ]
    assert tr.slices(datetime(2024, 1, 1), datetime(2024, 1, 1), day) == []


@pytest.fixture(scope="module")
def source(spark, sf):
    ship_package(spark)
    tr.register(spark)
    return spark.read.parquet(f"{sf}/events.parquet")


def options(path, **more):
    return {"path": path, "timeColumn": "ts", "sliceSeconds": "86400", **more}


@pytest.mark.parametrize("ends", [{}, {"start": "2024-01-05T00:00:00", "end": "2024-01-12T06:30:00"}, {"start": "2031-01-01T00:00:00"}])
def test_batch_equals_stream(spark, source, tmp_path, ends):
    path = f"{tmp_path}/in"
    source.repartition(3).write.parquet(path)
    low, high = ends.get("start", "1970-01-01T00:00:00"), ends.get("end", "2100-01-01T00:00:00")
    want = {r.event_id for r in source.where((F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.col("ts") < F.lit(high).cast("timestamp_ntz"))).collect()}
    batch = spark.read.format(tr.NAME).schema(source.schema).options(**options(path, **ends)).load()
    assert sorted(r.event_id for r in batch.collect()) == sorted(want)
    if want:
        assert batch.rdd.getNumPartitions() >= 7
        stream = spark.readStream.format(tr.NAME).schema(source.schema).options(**options(path, **ends)).load()
        assert sorted(r.event_id for r in st.run_available_now(stream.select("event_id"), "range", "append").collect()) == sorted(want)


def test_stream_goes_on_with_later_times(spark, source, tmp_path):
    path, cut = f"{tmp_path}/in", F.lit("2024-01-10").cast("timestamp_ntz")
    seen = []
    for part in (F.col("ts") < cut, F.col("ts") >= cut):
        source.where(part).write.mode("append").parquet(path)
        stream = spark.readStream.format(tr.NAME).schema(source.schema).options(**options(path)).load()
        out = st.run_available_now(stream.select("event_id"), "range", "append", root=f"{tmp_path}/root")
        seen.append(out.count())
    assert seen == [source.where("ts < '2024-01-10'").count(), source.count()]


def test_columns_are_the_callers(spark, source, tmp_path):
    path = f"{tmp_path}/in"
    source.write.parquet(path)
    out = spark.read.format(tr.NAME).schema("event_type string, event_id bigint").options(**options(path)).load()
    assert out.columns == ["event_type", "event_id"] and out.count() == source.count()
