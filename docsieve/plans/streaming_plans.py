"""Streaming queries: the given tables read as streams; the SQL is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsieve.operators import relational as rel
from docsieve.plans.registry import query, table
from docsieve.session import scratch_path
from docsieve.sources import time_range as tr
from docsieve.streaming import jobs as st

TS, SQL_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"


def fmt(c: str):
    return F.date_format(c, TS).alias(c)


def stream(spark, sf, name):
    """The table's files as a stream."""
    return st.read_stream(spark, f"{sf}/{name}*.parquet", table(spark, sf, name).schema)


def in_two_runs(spark, sf, name, first, run):
    """``run`` of a stream over a folder that gets a part of the table, then once more, with the same root, after the rest has come."""
    source, root = scratch_path(spark, f"{name}-files"), scratch_path(spark, f"{name}-root")
    rows = table(spark, sf, name)
    for part in (first, ~first):
        rows.where(part).write.mode("append").parquet(source)
        out = run(st.read_stream(spark, source, rows.schema), root)
    return out


def _bin(size: str) -> str:
    return f"time_bucket(INTERVAL '{size}', ts, TIMESTAMP '1970-01-01')"


@query("s01_dedup", f"SELECT user_id, event_type, strftime(min(ts), '{SQL_TS}') AS ts FROM events GROUP BY user_id, event_type, ts")
def s01(spark, sf):
    both = stream(spark, sf, "events").select("user_id", "event_type", "ts")
    twice = both.unionByName(stream(spark, sf, "events").select("user_id", "event_type", "ts"))
    out = st.dedup(twice, "ts", ["user_id", "event_type", "ts"], "1 hour")
    return st.run_available_now(out, "dedup", "append").withColumn("ts", fmt("ts"))


def _tumbling(size: str, sql_size: str) -> None:
    @query(f"s02_tumbling_{size.replace(' ', '_')}", f"""
      SELECT strftime({_bin(sql_size)}, '{SQL_TS}') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY {_bin(sql_size)}, event_type""")
    def run(spark, sf):
        out = st.windowed(stream(spark, sf, "events"), "ts", "1 hour", size, ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
        done = st.run_available_now(out, "tumbling", "update", ["window_start", "event_type"])
        return done.select(fmt("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


_tumbling("15 minutes", "15 minutes")
_tumbling("1 day", "1 day")


@query("s03_sliding", f"""
  SELECT strftime(w, '{SQL_TS}') AS window_start, count(*) AS n, round(avg(value), 6) AS mean_value FROM (
    SELECT value, {_bin('1 hour')} - CAST(i AS INTEGER) * INTERVAL 1 HOUR AS w FROM events, unnest(range(6)) AS g(i)) GROUP BY w""")
def s03(spark, sf):
    out = st.windowed(stream(spark, sf, "events"), "ts", "1 hour", "6 hours", [], [F.count("*").alias("n"), F.avg("value").alias("mean_value")], "1 hour")
    done = st.run_available_now(out, "sliding", "update", ["window_start"])
    return done.select(fmt("window_start"), "n", F.round("mean_value", 6).alias("mean_value"))


def _sessions_sql(source: str, aggs: str) -> str:
    """Sessions with a 30-minute gap that a one-hour watermark has closed."""
    return f"""
      SELECT strftime(min(ts), '{SQL_TS}') AS window_start, strftime(max(ts) + INTERVAL 30 MINUTE, '{SQL_TS}') AS window_end, user_id, {aggs} FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
          SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ({source})))
      GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM ({source}))"""


@query("s04_sessions", _sessions_sql("SELECT * FROM events", "count(*) AS events, arg_min(event_type, ts) AS first_type, arg_max(event_type, ts) AS last_type"))
def s04(spark, sf):
    # First and last kind rather than the whole sequence: a session has no longest length.
    aggs = [F.count("*").alias("events"), F.min_by("event_type", "ts").alias("first_type"), F.max_by("event_type", "ts").alias("last_type")]
    out = st.sessions(stream(spark, sf, "events"), "ts", "1 hour", "30 minutes", ["user_id"], aggs)
    return st.run_available_now(out, "sessions", "append").withColumns({"window_start": fmt("window_start"), "window_end": fmt("window_end")})


_LATE_SQL = "CASE WHEN value * 20 <= 300 THEN 'on_time' WHEN value * 20 <= 3600 THEN 'late' ELSE 'very_late' END"


@query("s05_late_rates", f"""
  SELECT strftime({_bin('1 hour')}, '{SQL_TS}') AS window_start, count(*) AS events, CAST(count_if(c = 'on_time') AS BIGINT) AS on_time, CAST(count_if(c = 'late') AS BIGINT) AS late,
    CAST(count_if(c = 'very_late') AS BIGINT) AS very_late, round(count_if(c <> 'on_time') / count(*), 6) AS late_share FROM (SELECT *, {_LATE_SQL} AS c FROM events) GROUP BY {_bin('1 hour')}""")
def s05(spark, sf):
    out = st.late_rates(stream(spark, sf, "events"), "ts", F.col("value") * 20, "1 hour")
    done = st.run_available_now(out, "late", "update", ["window_start"])
    return done.select(fmt("window_start"), "events", "on_time", "late", "very_late", F.round("late_share", 6).alias("late_share"))


@query("s05_dead_letters", f"SELECT route, count(*) AS n FROM (SELECT CASE WHEN {_LATE_SQL} = 'very_late' THEN 'dead' ELSE 'main' END AS route FROM events) GROUP BY route")
def s05_dead(spark, sf):
    very = st.late_class(F.col("value") * 20) == "very_late"
    sinks = st.fan_out(stream(spark, sf, "events"), "late-routes", {"main": lambda b: b.where(~very), "dead": lambda b: b.where(very)})
    parts = [sinks.read(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("route"), "n") for n in ("main", "dead")]
    return parts[0].unionByName(parts[1])


def _dim(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment")


@query("s06_enrich", "SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id")
def s06(spark, sf):
    out = st.enrich(stream(spark, sf, "events"), _dim(spark, sf), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment")
    return st.run_available_now(out, "enrich", "append")


@query("s07_backfill", "SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id")
def s07(spark, sf):
    # The dimension is complete only after the stream has run: rich customers come late.
    early = _dim(spark, sf).join(table(spark, sf, "customer").where("c_acctbal > 2000").select("c_custkey"), "c_custkey", "left_semi")
    out = st.enrich(stream(spark, sf, "events"), early, F.col("user_id") == F.col("c_custkey")).select("event_id", "user_id", "c_mktsegment")
    rows = st.run_available_now(out, "enrich", "append")
    return st.backfill(rows, table(spark, sf, "customer"), "user_id", "c_custkey", ["c_mktsegment"]).select("event_id", "c_mktsegment")


def _kind(df, kind, prefix):
    return df.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{prefix}_id"), F.col("user_id").alias(f"{prefix}_user"), F.col("ts").alias(f"{prefix}_ts"))


_PAIR_SQL = "FROM (SELECT * FROM events WHERE event_type = 'view') v {} JOIN (SELECT * FROM events WHERE event_type = 'click') c ON c.user_id = v.user_id AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL 1 HOUR"


def _interval(v, c, how):
    return st.interval_join(v, c, "v_ts", "c_ts", F.col("v_user") == F.col("c_user"), "2 hours", 3600, how)


@query("s08_interval_join", f"SELECT v.event_id AS v_id, c.event_id AS c_id {_PAIR_SQL.format('INNER')}")
def s08(spark, sf):
    v, c = _kind(stream(spark, sf, "events"), "view", "v"), _kind(stream(spark, sf, "events"), "click", "c")
    return st.run_available_now(_interval(v, c, "inner").select("v_id", "c_id"), "interval", "append")


@query("s08_interval_join_left", f"SELECT v.event_id AS v_id, c.event_id AS c_id {_PAIR_SQL.format('LEFT')}")
def s08_left(spark, sf):
    # Unmatched rows appear once the watermark has passed them: two events ten days later close the stream.
    source, rows = scratch_path(spark, "interval-files"), table(spark, sf, "events")
    end = rows.agg(F.timestamp_add("DAY", F.lit(10), F.max("ts")).alias("ts"))
    closing = end.select(
        F.lit(-1).cast("bigint").alias("event_id"), "ts", F.lit(-1).cast("bigint").alias("user_id"),
        F.explode(F.array(F.lit("view"), F.lit("click"))).alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"),
    )
    rows.unionByName(closing).write.parquet(source)
    events = st.read_stream(spark, source, rows.schema)
    joined = _interval(_kind(events, "view", "v"), _kind(events, "click", "c"), "left_outer").select("v_id", "c_id")
    return st.run_available_now(joined, "interval-left", "append").where("v_id >= 0")


@query("s09_paired_sessions", f"SELECT * FROM ({_sessions_sql(chr(10) + 'SELECT * FROM events WHERE event_type IN (' + repr('view') + ', ' + repr('click') + ')', 'CAST(count_if(event_type = ' + repr('view') + ') AS BIGINT) AS first_events, CAST(count_if(event_type = ' + repr('click') + ') AS BIGINT) AS second_events')}) WHERE first_events > 0 AND second_events > 0")
def s09(spark, sf):
    out = st.paired_sessions(stream(spark, sf, "events"), "ts", "1 hour", "30 minutes", ["user_id"], "event_type", "view", "click")
    return st.run_available_now(out, "paired", "append").withColumns({"window_start": fmt("window_start"), "window_end": fmt("window_end")})


@query("s10_running_totals", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def s10(spark, sf):
    done = st.run_available_now(st.running_totals(stream(spark, sf, "events"), ["user_id"], "value"), "totals", "update", ["user_id"])
    return done.withColumn("total", F.round("total", 4))


_OUTLIER_SQL = """
  SELECT event_id, round(m, 9) AS mean, round(s, 9) AS std, abs(value - m) > 3 * s AS is_outlier FROM (
    SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND CURRENT ROW))"""


def _outlier_cols(df):
    return df.select("event_id", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "is_outlier")


@query("s11_rolling_outliers", _OUTLIER_SQL)
def s11(spark, sf):
    out = rel.rolling_outliers(table(spark, sf, "events"), "event_type", ["ts", "event_id"], F.date_trunc("hour", "ts"), "value")
    return _outlier_cols(out)


@query("s11_rolling_outliers_hot", _OUTLIER_SQL)
def s11_hot(spark, sf):
    # Small blocks, so that every key has several.
    out = rel.rolling_outliers(table(spark, sf, "events"), "event_type", ["ts", "event_id"], F.date_trunc("hour", "ts"), "value", block=500)
    return _outlier_cols(out)


@query("s11_stream_outliers", _OUTLIER_SQL)
def s11_stream(spark, sf):
    e = stream(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return _outlier_cols(st.stream_outliers(e, "outliers", "event_type", "ts", "event_id", "value"))


@query("s12_lag_monitor", f"SELECT strftime(date_trunc('minute', ts), '{SQL_TS}') AS window_start, count(*) AS events, strftime(max(ts), '{SQL_TS}') AS newest FROM events GROUP BY date_trunc('minute', ts)")
def s12(spark, sf):
    done = st.run_available_now(st.lag_monitor(stream(spark, sf, "events"), "ts", "1 hour"), "lag", "update", ["window_start"])
    return done.select(fmt("window_start"), "events", fmt("newest"))


@query("s13_multi_sink", "SELECT 'raw' AS sink, count(*) AS n FROM events UNION ALL SELECT 'clean', count(*) FROM events WHERE event_type <> 'error' UNION ALL SELECT 'per_type', count(DISTINCT event_type) FROM events")
def s13(spark, sf):
    outputs = {
        "raw": lambda b: b, "clean": lambda b: b.where(F.col("event_type") != "error"),
        "per_type": lambda b: b.groupBy("event_type").agg(F.count("*").alias("n")),
    }
    sinks = in_two_runs(spark, sf, "events", F.col("event_id") % 3 == 0, lambda s, root: st.fan_out(s, "multi", outputs, root))
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("sink"), "n")
    per_type = sinks.read("per_type").select("event_type").distinct()
    return count("raw", sinks.read("raw")).unionByName(count("clean", sinks.read("clean"))).unionByName(count("per_type", per_type))


@query("s14_route_by_type", "SELECT CASE WHEN event_id % 10 = 0 THEN 'dead' WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS route, count(*) AS n FROM events GROUP BY 1")
def s14(spark, sf):
    broken = F.when(F.col("event_id") % 10 == 0, F.left(F.col("props"), F.lit(4))).otherwise(F.col("props"))
    ok = F.col("p.k").isNotNull()
    kind = lambda b, *names: b.where(ok & F.col("event_type").isin(*names))
    routes = {
        "view": lambda b: kind(b, "view"), "click": lambda b: kind(b, "click"),
        "other": lambda b: b.where(ok & ~F.col("event_type").isin("view", "click")), "dead": lambda b: b.where(~ok),
    }
    parsed = lambda s: s.withColumn("p", F.from_json(broken, "k bigint")).select("event_id", "event_type", "p")
    sinks = in_two_runs(spark, sf, "events", F.col("event_id") % 2 == 0, lambda s, root: st.fan_out(parsed(s), "routes", routes, root))
    parts = [sinks.read(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("route"), "n") for n in routes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_CDC_SQL = "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND o_orderstatus <> 'P'"


@query("s15_apply_changes", f"SELECT 'all' AS target, o_custkey, o_orderkey, o_totalprice FROM ({_CDC_SQL}) UNION ALL SELECT 'large', o_custkey, o_orderkey, o_totalprice FROM ({_CDC_SQL}) WHERE o_totalprice > 200000")
def s15(spark, sf):
    empty = spark.createDataFrame([], "o_custkey bigint, o_orderkey bigint, o_totalprice double")
    # In the second target a change to a small value is a delete.
    large = lambda b: b.withColumn("_gone", F.col("_gone") | (F.col("o_totalprice") <= 200000))
    out = in_two_runs(spark, sf, "orders", F.year("o_orderdate") < 1996, lambda s, root: st.apply_changes(
        s, "cdc", empty, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "P", {"all": lambda b: b, "large": large}, root,
    ))
    return out["all"].withColumn("target", F.lit("all")).unionByName(out["large"].withColumn("target", F.lit("large")))


@query("s16_available_now", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def s16(spark, sf):
    counts = lambda s: s.groupBy("lang").agg(F.count("*").alias("n"))
    return in_two_runs(spark, sf, "documents", F.col("doc_id") % 4 == 0, lambda s, root: st.run_available_now(counts(s), "docs", "complete", root=root))


@query("s17_guardrail_windows", f"""
  SELECT strftime({_bin('1 day')}, '{SQL_TS}') AS window_start, count(*) AS requests, CAST(count_if(event_type = 'error') AS BIGINT) AS pre_blocks, CAST(count_if(event_type = 'click') AS BIGINT) AS post_blocks,
    round(count_if(event_type = 'error') / count(*), 6) AS pre_rate FROM events GROUP BY {_bin('1 day')}""")
def s17(spark, sf):
    out = st.guardrail_windows(stream(spark, sf, "events"), "ts", "1 hour", "1 day", F.col("event_type") == "error", F.col("event_type") == "click")
    done = st.run_available_now(out, "guard", "update", ["window_start"])
    return done.select(fmt("window_start"), "requests", "pre_blocks", "post_blocks", F.round("pre_rate", 6).alias("pre_rate"))


@query("s17_rate_limit", f"""
  SELECT strftime({_bin('1 hour')}, '{SQL_TS}') AS window_start, user_id, count(*) AS requests FROM events GROUP BY {_bin('1 hour')}, user_id
  HAVING count(*) > 1 AND {_bin('1 hour')} + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def s17_limit(spark, sf):
    out = st.rate_limit_windows(stream(spark, sf, "events"), "ts", "1 hour", "user_id", 1, "1 hour")
    return st.run_available_now(out, "limit", "append").select(fmt("window_start"), "user_id", "requests")


@query("s19_time_range", f"SELECT event_id, strftime(ts, '{SQL_TS}') AS ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:30:00' AND ts < TIMESTAMP '2024-01-20'")
def s19(spark, sf):
    """The events of a range of time, read in slices of a day."""
    rows, path = table(spark, sf, "events"), scratch_path(spark, "time-range")
    rows.write.parquet(path)
    tr.register(spark)
    kept = "event_id bigint, ts timestamp_ntz, event_type string"
    ends = {"start": "2024-01-05T06:30:00", "end": "2024-01-20T00:00:00"}
    return spark.read.format(tr.NAME).schema(kept).options(path=path, timeColumn="ts", sliceSeconds="86400", **ends).load().withColumn("ts", fmt("ts"))


@query("s18_thread_states", "SELECT conv_id, count(*) AS messages, CAST(count_if(role = 'user') AS INTEGER) AS turn_count, max(turn) AS updated_at, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def s18(spark, sf):
    return st.thread_states(stream(spark, sf, "conversations"), "threads")
