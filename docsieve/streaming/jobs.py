"""Structured Streaming: running a stream to its end, sinks that survive replays, and the stream operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docsieve.operators.history import latest_per_key, merge_upsert
from docsieve.operators.relational import rolling_outliers
from docsieve.session import cut_lineage, scratch_path

# ---------------------------------------------------------------- sources and triggers


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of parquet files; wall-clock times become timestamps, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(path)
    ntz = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def trigger(interval: str | None = None) -> dict:
    """``availableNow`` works off what is there and stops; an interval keeps micro-batches coming."""
    return {"availableNow": True} if interval is None else {"processingTime": interval}


def run_available_now(df: DataFrame, label: str, mode: str, keys: list[str] | None = None, root: str | None = None) -> DataFrame:
    """Run a stream over everything that is there and return what it wrote.

    Each micro-batch goes to its own folder and a replayed batch overwrites
    its own, so results are exact after failures. In ``update`` mode the last
    version per key counts, in ``complete`` mode the last batch. A caller's
    ``root`` keeps checkpoint and output: a later run reads only what has come
    since, and the result is that of all runs. Without one the run starts anew.
    """
    spark = df.sparkSession
    root = root or scratch_path(spark, label)
    out, log = f"{root}/out", f"{root}/log"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", log).foreachBatch(write).trigger(**trigger()).start()
    q.awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(schema).parquet(out)
    if mode == "update":
        rows = latest_per_key(rows, keys or [], ["batch_id"])
    elif mode == "complete":
        rows = rows.where(F.col("batch_id") == rows.agg(F.max("batch_id").alias("b")).scalar())
    return rows.drop("batch_id")


def start_batches(df: DataFrame, root: str, work: Callable[[DataFrame, int], None], interval: str | None = None) -> StreamingQuery:
    """Start ``work`` on every micro-batch, from where ``root``'s checkpoint stands; it must write so that doing a batch twice changes nothing."""
    return df.writeStream.option("checkpointLocation", f"{root}/log").foreachBatch(work).trigger(**trigger(interval)).start()


def run_batches(df: DataFrame, root: str, work: Callable[[DataFrame, int], None]) -> None:
    """``start_batches`` over everything that is there."""
    start_batches(df, root, work).awaitTermination()


# ---------------------------------------------------------------- single-stream operators


def dedup(df: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def _window_cols(w: str = "window") -> list[Column]:
    return [F.col(f"{w}.start").alias("window_start"), F.col(f"{w}.end").alias("window_end")]


def windowed(
    df: DataFrame, ts: str, delay: str, size: str, by: list[str], aggs: list[Column], slide: str | None = None
) -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.withWatermark(ts, delay).groupBy(w, *by).agg(*aggs)
    return out.select(*_window_cols(), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, ts: str, delay: str, gap: str, by: list[str], aggs: list[Column]) -> DataFrame:
    """Session windows: a session ends after ``gap`` without an event."""
    out = df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *by).agg(*aggs)
    return out.select(*_window_cols("session_window"), *[c for c in out.columns if c != "session_window"])


def late_class(delay_seconds: Column, on_time: int = 300, late: int = 3600) -> Column:
    return F.when(delay_seconds <= on_time, "on_time").when(delay_seconds <= late, "late").otherwise("very_late")


def late_rates(df: DataFrame, ts: str, delay_seconds: Column, delay: str, size: str = "1 hour") -> DataFrame:
    """Per window: events, how many came late, and the share."""
    cls = late_class(delay_seconds)
    n = lambda name: F.sum(F.when(cls == name, 1).otherwise(0)).cast("bigint").alias(name)
    out = windowed(df, ts, delay, size, [], [F.count("*").alias("events"), n("on_time"), n("late"), n("very_late")])
    return out.withColumn("late_share", (F.col("late") + F.col("very_late")) / F.col("events"))


def running_totals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Totals per key since the start; run in update mode."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def lag_monitor(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Per minute: events and the newest event time."""
    return windowed(df, ts, delay, "1 minute", [], [F.count("*").alias("events"), F.max(ts).alias("newest")])


def guardrail_windows(df: DataFrame, ts: str, delay: str, size: str, pre: Column, post: Column) -> DataFrame:
    """Block rates per window."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    out = windowed(df, ts, delay, size, [], [F.count("*").alias("requests"), n(pre).alias("pre_blocks"), n(post).alias("post_blocks")])
    return out.withColumns({"pre_rate": F.col("pre_blocks") / F.col("requests"), "post_rate": F.col("post_blocks") / F.col("requests")})


def rate_limit_windows(df: DataFrame, ts: str, delay: str, key: str, limit: int, size: str = "1 minute") -> DataFrame:
    """Windows in which a key went over its limit (append mode: a closed window's count is final)."""
    return windowed(df, ts, delay, size, [key], [F.count("*").alias("requests")]).where(F.col("requests") > limit)


# ---------------------------------------------------------------- two inputs


def enrich(stream: DataFrame, dim: DataFrame, on: Column) -> DataFrame:
    """Left join with a static dimension; a dimension under the broadcast threshold is broadcast."""
    return stream.join(dim, on, "left")


def backfill(rows: DataFrame, dim: DataFrame, key: str, dim_key: str, cols: list[str]) -> DataFrame:
    """Batch repair of enriched rows whose dimension was missing at the time."""
    late = dim.select(F.col(dim_key).alias("_dk"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    gaps = rows.where(F.col(cols[0]).isNull()).join(late, F.col(key) == F.col("_dk"), "left")
    fixed = gaps.select(*[F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c) if c in cols else F.col(c) for c in rows.columns])
    return rows.where(F.col(cols[0]).isNotNull()).unionByName(fixed)


def interval_join(
    left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, on: Column, delay: str, within_seconds: int, how: str = "inner"
) -> DataFrame:
    """Right events on the left event's key from its time until ``within_seconds`` later. Streams or tables.

    Time is cut into buckets of that length and a right event is put into its
    own and the bucket before, so a left event meets all it can match in its
    own bucket. The bucket is part of the join key: a hot key is spread over
    its buckets and compares neighbours only.
    """
    if left.isStreaming:
        left, right = left.withWatermark(left_ts, delay), right.withWatermark(right_ts, delay)
    bucket = lambda ts: F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / within_seconds)
    placed = right.withColumn("_rb", F.explode(F.array(bucket(right_ts), bucket(right_ts) - 1)))
    near = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {within_seconds} seconds"))
    joined = left.withColumn("_lb", bucket(left_ts)).join(placed, on & (F.col("_lb") == F.col("_rb")) & near, how)
    return joined.drop("_lb", "_rb")


def paired_sessions(df: DataFrame, ts: str, delay: str, gap: str, by: list[str], kind: str, first: str, second: str) -> DataFrame:
    """Sessions over the union of two kinds of events, with a count per kind; both kinds must occur."""
    n = lambda k: F.sum(F.when(F.col(kind) == k, 1).otherwise(0)).cast("bigint")
    both = df.where(F.col(kind).isin(first, second))
    out = sessions(both, ts, delay, gap, by, [n(first).alias("first_events"), n(second).alias("second_events")])
    return out.where((F.col("first_events") > 0) & (F.col("second_events") > 0))


# ---------------------------------------------------------------- several sinks


class BatchSinks:
    """Named sinks of a stream below one folder: a folder per micro-batch each, so a replay replaces its own output."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def write(self, name: str, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch_id}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}").drop("batch_id")


def fan_out(stream: DataFrame, label: str, outputs: dict[str, Callable[[DataFrame], DataFrame]], root: str | None = None) -> BatchSinks:
    """Several outputs from one read of each micro-batch; with a ``root`` a later run goes on where the last one ended."""
    sinks = BatchSinks(stream.sparkSession, root or scratch_path(stream.sparkSession, label))

    def work(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for name, make in outputs.items():
                sinks.write(name, make(held), batch_id)
        finally:
            held.unpersist()

    run_batches(stream, sinks.root, work)
    return sinks


class Versions:
    """Versions of several targets below one folder, and a manifest of those that are whole.

    A version counts once its number stands in the manifest, which is written
    after all targets: a batch that failed half-way leaves nothing to be read,
    and its replay writes the same version again.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root, schema

    def newest(self, before: int | None = None) -> int | None:
        """The last whole version (below ``before``), or None."""
        listed = self.spark.read.schema("version bigint, written_at timestamp").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true")
        self._touch()
        rows = listed.parquet(f"{self.root}/manifest")
        rows = rows if before is None else rows.where(F.col("version") < before)
        return rows.agg(F.max("version")).first()[0]

    def _touch(self) -> None:
        """The manifest's folder, so that it can be listed before the first version."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)

    def read(self, name: str, version: int | None) -> DataFrame:
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}/v{version}")

    def write(self, name: str, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version}")

    def commit(self, version: int) -> None:
        row = self.spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.current_timestamp().alias("written_at"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v{version}")


def apply_changes(
    stream: DataFrame, label: str, empty: DataFrame, keys: list[str], order: list[str], deleted: Column,
    views: dict[str, Callable[[DataFrame], DataFrame]], root: str | None = None,
) -> dict[str, DataFrame]:
    """Change data into several targets: each keeps the merged state of its own view of the changes.

    A batch makes version ``batch_id`` of every target from the whole version
    before it, as the manifest has it, so a replayed batch writes the same
    again, and a later run under the same ``root`` goes on from the last whole
    version. ``empty`` has the columns of a change without its operation; views
    keep them. Changes of a key come in order from batch to batch.
    """
    spark = stream.sparkSession
    versions = Versions(spark, root or scratch_path(spark, label), empty.schema)

    def work(batch: DataFrame, batch_id: int) -> None:
        last = latest_per_key(batch.withColumn("_gone", deleted), keys, order)
        held = last.persist()
        try:
            earlier = versions.newest(batch_id)
            for name, view in views.items():
                changes = view(held).select(*empty.columns, "_gone")
                versions.write(name, merge_upsert(versions.read(name, earlier), changes, keys, F.col("_gone")), batch_id)
        finally:
            held.unpersist()
        versions.commit(batch_id)

    run_batches(stream, versions.root, work)
    newest = versions.newest()
    return {name: versions.read(name, newest) for name in views}


def stream_outliers(
    stream: DataFrame, label: str, key: str, ts: str, tie: str, value: str, rows: int = 100, sigmas: float = 3.0, root: str | None = None
) -> DataFrame:
    """Rolling outliers over a stream whose batches arrive in time order.

    Row windows do not exist on streams; each micro-batch runs the batch
    operator behind the last ``rows`` rows per key of the batch before, which
    are written with it: a later run under the same ``root`` goes on from them.
    """
    spark = stream.sparkSession
    sinks = BatchSinks(spark, root or scratch_path(spark, label))
    cols = stream.columns

    def work(batch: DataFrame, batch_id: int) -> None:
        seen = batch.withColumn("_new", F.lit(True))
        if batch_id:
            kept = spark.read.parquet(f"{sinks.root}/tail/batch_id={batch_id - 1}")
            seen = kept.withColumn("_new", F.lit(False)).unionByName(seen)
        seen = cut_lineage(seen, f"{label}-batch")
        flagged = rolling_outliers(seen, key, [ts, tie], F.date_trunc("hour", ts), value, rows, sigmas)
        sinks.write("rows", flagged.where("_new").drop("_new"), batch_id)
        w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
        tail = seen.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows)
        sinks.write("tail", tail.select(*cols), batch_id)

    run_batches(stream, sinks.root, work)
    return sinks.read("rows")


def thread_states(stream: DataFrame, label: str) -> DataFrame:
    """Conversation state per thread from a stream of messages: user turns, latest turn, latest role."""
    return run_available_now(
        stream.groupBy("conv_id").agg(
            F.count("*").alias("messages"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).cast("int").alias("turn_count"),
            F.max("turn").alias("updated_at"), F.max_by("role", "turn").alias("last_role"),
        ), label, "update", ["conv_id"],
    )
