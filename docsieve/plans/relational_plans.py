"""Relational, change-data, quality and trace queries on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docsieve.functions.text import tokens
from docsieve.operators import history as hi
from docsieve.operators import quality as qu
from docsieve.operators import relational as rel
from docsieve.operators import traces as tr
from docsieve.operators.scale import running
from docsieve.operators.screening import PII_PATTERNS, mask_pii
from docsieve.plans.evaluation_plans import traces as assessed_traces
from docsieve.plans.registry import query, table, text_table
from docsieve.plans.retrieval_plans import sql_tokens

D = "%Y-%m-%d"


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


# ---------------------------------------------------------------- test data and its faults


def _uniform_sql(salt: int) -> str:
    return f"((CAST('0x' || left(md5(CAST(c_custkey AS VARCHAR) || ':{salt}'), 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)"


@query("a102_master_table", f"""
  SELECT c_custkey AS customer_idx, tier, region, round(exp(CASE tier WHEN 'Enterprise' THEN 7.5e0 WHEN 'Pro' THEN 5.5e0 ELSE 4e0 END
    + CASE tier WHEN 'Enterprise' THEN 0.8e0 WHEN 'Pro' THEN 0.7e0 ELSE 0.6e0 END * sqrt(-2 * ln(a)) * cos(2 * pi() * b)), 1) AS arr
  FROM (SELECT c_custkey, CASE WHEN t < 0.6e0 THEN 'Free' WHEN t < 0.6e0 + 0.3e0 THEN 'Pro' ELSE 'Enterprise' END AS tier,
      CASE WHEN r < 0.4e0 THEN 'North' WHEN r < 0.4e0 + 0.25e0 THEN 'South' WHEN r < 0.4e0 + 0.25e0 + 0.2e0 THEN 'East' ELSE 'West' END AS region, a, b
    FROM (SELECT c_custkey, {_uniform_sql(42)} AS t, {_uniform_sql(43)} AS r, {_uniform_sql(44)} AS a, {_uniform_sql(45)} AS b FROM customer))""")
def a102(spark, sf):
    made = qu.master_of(table(spark, sf, "customer"), "c_custkey", places=1)
    return made.select("customer_idx", "tier", "region", "arr")


@query("a103_child_table", "SELECT count(*) AS orders, count(*) AS with_customer FROM orders")
def a103(spark, sf):
    customers = table(spark, sf, "customer")
    made = qu.child_table(table(spark, sf, "orders"), "o_orderkey", qu.master_of(customers, "c_custkey"), customers.count())
    return made.agg(F.count("*").alias("orders"), F.count("customer_id").alias("with_customer"))


# Shares by the order's number modulo 100, so that SQL picks the same rows.
_FAULTY_SQL = """
  SELECT o_orderkey, CASE WHEN o_orderkey % 100 < 2 THEN NULL WHEN o_orderkey % 100 BETWEEN 5 AND 8 THEN -1 - o_custkey ELSE o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 100 BETWEEN 2 AND 4 THEN -abs(o_totalprice) ELSE o_totalprice END AS o_totalprice FROM orders"""


def _faulty(spark, sf):
    return qu.inject_faults(
        table(spark, sf, "orders"), (F.col("o_orderkey") % 100) / 100, {"null_key": 0.02, "bad_amount": 0.03, "orphan": 0.04},
        "o_custkey", "o_totalprice", -1 - F.col("o_custkey"),
    ).select("o_orderkey", "o_custkey", "o_totalprice")


@query("a104_inject_faults", _FAULTY_SQL)
def a104(spark, sf):
    return _faulty(spark, sf)


@query("a105_detect_faults", f"""
  SELECT 'null_key' AS issue, count(*) AS rows FROM ({_FAULTY_SQL}) WHERE o_custkey IS NULL UNION ALL
  SELECT 'bad_amount', count(*) FROM ({_FAULTY_SQL}) WHERE o_totalprice < 0 UNION ALL
  SELECT 'orphan', count(*) FROM ({_FAULTY_SQL}) WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def a105(spark, sf):
    return qu.detect_faults(_faulty(spark, sf), "o_custkey", "o_totalprice", table(spark, sf, "customer"), "c_custkey")


@query("a106_distribution", "SELECT o_orderpriority, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY o_orderpriority")
def a106(spark, sf):
    return qu.distribution(table(spark, sf, "orders"), "o_orderpriority").withColumn("share", F.round("share", 6))


# ---------------------------------------------------------------- relational surface


@query("b01_projection", f"""
  SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_quantity / 10, 4) AS l_quantity, strftime(l_shipdate, '{D}') AS l_shipdate FROM lineitem""")
def b01(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({
        "net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), "l_quantity": F.round(F.col("l_quantity") / 10, 4),
        "l_shipdate": day("l_shipdate"),
    })
    return li.drop("l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query("b02_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_quantity < 24 AND l_discount BETWEEN 0.05 AND 0.07")
def b02(spark, sf):
    # Literals of the column's own type, so that the filters reach the scan.
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, sf, "lineitem").where(
        (F.col("l_shipdate") >= at("1997-01-01")) & (F.col("l_shipdate") < at("1998-01-01")) & (F.col("l_quantity") < 24)
        & F.col("l_discount").between(0.05, 0.07)
    ).select("l_orderkey", "l_linenumber")


_AGG_SQL = "count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS avg_discount, max(l_extendedprice) AS max_price, count(DISTINCT l_suppkey) AS suppliers"


def _aggs():
    return [
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.max("l_extendedprice").alias("max_price"), F.countDistinct("l_suppkey").alias("suppliers"),
    ]


@query("b03_aggregate", f"SELECT l_returnflag, l_linestatus, {_AGG_SQL} FROM lineitem GROUP BY 1, 2")
def b03(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(*_aggs())


@query("b03_aggregate_all", f"SELECT {_AGG_SQL} FROM lineitem")
def b03_all(spark, sf):
    return table(spark, sf, "lineitem").agg(*_aggs())


def _join_sides(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return c, o


def _join_query(how: str, sql_how: str) -> None:
    @query(f"b04_join_{how}", f"""
      SELECT c_custkey, o_orderkey FROM customer {sql_how} JOIN orders ON c_custkey = o_custkey""")
    def run(spark, sf):
        c, o = _join_sides(spark, sf)
        return c.join(o, c.c_custkey == o.o_custkey, how).select("c_custkey", "o_orderkey")


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):
    _join_query(_how, _sql)


@query("b04_join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def b04_semi(spark, sf):
    c, o = _join_sides(spark, sf)
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


# Customers without an urgent order in progress.
@query("b04_join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def b04_anti(spark, sf):
    c, o = _join_sides(spark, sf)
    return c.join(o, (c.c_custkey == o.o_custkey) & (o.o_orderstatus == "P") & (o.o_orderpriority == "1-URGENT"), "left_anti").select("c_custkey")


@query("b05_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def b05(spark, sf):
    return table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(5).limit(20).select("o_orderkey", "o_totalprice")


_SETS = {
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
}
_SET_OPS = {
    "union_all": lambda a, b: a.unionByName(b), "union": lambda a, b: a.unionByName(b).distinct(),
    "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b), "except_all": lambda a, b: a.exceptAll(b),
}


def _set_query(name: str) -> None:
    @query(f"b06_{name}", _SETS[name])
    def run(spark, sf):
        a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
        b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
        return _SET_OPS[name](a, b)


for _name in _SETS:
    _set_query(_name)


@query("b07_sample", """
  SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE CAST('0x' || left(md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':42'), 8) AS BIGINT) < 429496729""")
def b07(spark, sf):
    return rel.sample_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 0.1, 42).select("l_orderkey", "l_linenumber", "l_returnflag")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PIVOT_SQL = "SELECT o_orderstatus, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderpriority = '{p}'), 2) AS \"{p}\"" for p in _PRIORITIES) + " FROM orders GROUP BY o_orderstatus"


def _pivot(spark, sf):
    # The categories are given, so no job has to look for them first.
    return table(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", _PRIORITIES).agg(F.round(F.sum("o_totalprice"), 2))


@query("b08_pivot", _PIVOT_SQL)
def b08(spark, sf):
    return _pivot(spark, sf)


@query("b08_unpivot", f"SELECT o_orderstatus, priority, price FROM (UNPIVOT ({_PIVOT_SQL}) ON {', '.join(chr(34) + p + chr(34) for p in _PRIORITIES)} INTO NAME priority VALUE price)")
def b08_unpivot(spark, sf):
    return _pivot(spark, sf).unpivot("o_orderstatus", _PRIORITIES, "priority", "price")


@query("b09_pipe_syntax", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value FROM events WHERE value > 10 GROUP BY event_type HAVING count(*) > 1")
def b09(spark, sf):
    return spark.sql(
        """FROM {events} |> WHERE value > 10
           |> AGGREGATE count(*) AS n, round(avg(value), 4) AS mean_value GROUP BY event_type |> WHERE n > 1""",
        events=table(spark, sf, "events"),
    )


@query("b10_latest_per_key", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def b10(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return hi.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("b11_hierarchy", """
  WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 4 END AS parent FROM part),
    h AS (SELECT node, parent, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.node, n.parent, h.depth + 1 FROM n JOIN h ON n.parent = h.node WHERE h.depth < 5)
  SELECT node, parent, CAST(depth AS INTEGER) AS depth FROM h""")
def b11(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 0, F.expr("(p_partkey - 1) div 4")).alias("parent"))
    return rel.hierarchy(nodes, ["node"], ["parent"], 5)


# ---------------------------------------------------------------- change data

_CHANGES_SQL = "SELECT o_custkey AS k, o_orderdate AS seen_at, o_orderkey AS tie, o_orderpriority AS priority, o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS gone FROM orders"


def _changes(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("tie"), F.col("o_orderpriority").alias("priority"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0)).alias("gone"),
    )


@query("b12_scd1", f"SELECT k, tie, priority FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seen_at DESC, tie DESC) AS r FROM ({_CHANGES_SQL})) WHERE r = 1 AND NOT gone")
def b12(spark, sf):
    return hi.scd1(_changes(spark, sf), ["k"], ["at", "tie"], F.col("gone")).select("k", "tie", "priority")


_SCD2_SQL = f"""
  SELECT k, priority, seen_at AS start_at, next_at AS end_at FROM (
    SELECT *, lead(seen_at) OVER (PARTITION BY k ORDER BY seen_at, tie) AS next_at FROM (
      SELECT *, lag(priority) OVER (PARTITION BY k ORDER BY seen_at, tie) AS p, lag(gone) OVER (PARTITION BY k ORDER BY seen_at, tie) AS g FROM ({_CHANGES_SQL}))
    WHERE g IS NULL OR p IS DISTINCT FROM priority OR g <> gone) WHERE NOT gone"""


def _history(spark, sf, **kw):
    return hi.scd2(_changes(spark, sf), ["k"], "at", "tie", ["priority"], F.col("gone"), **kw)


_SCD2_DAYS_SQL = f"SELECT k, priority, strftime(start_at, '{D}') AS start_at, strftime(end_at, '{D}') AS end_at FROM ({_SCD2_SQL})"


@query("b13_scd2", _SCD2_DAYS_SQL)
def b13(spark, sf):
    return _history(spark, sf).withColumns({"start_at": day("start_at"), "end_at": day("end_at")})


@query("b13_scd2_hot", _SCD2_DAYS_SQL)
def b13_hot(spark, sf):
    # Coarse slices: many changes of a key lie in one.
    out = _history(spark, sf, slice_of=F.year("start_at"))
    return out.withColumns({"start_at": day("start_at"), "end_at": day("end_at")})


@query("b14_point_in_time", f"""
  SELECT k, priority, end_at IS NULL AS is_current, CAST(date_diff('day', start_at, coalesce(end_at, TIMESTAMP '2002-01-01')) AS INTEGER) AS days_active
  FROM ({_SCD2_SQL}) WHERE start_at <= TIMESTAMP '1998-06-30' AND (end_at IS NULL OR end_at > TIMESTAMP '1998-06-30')""")
def b14(spark, sf):
    at = F.lit("1998-06-30").cast("timestamp_ntz")
    out = hi.days_active(hi.as_of(_history(spark, sf), at), F.lit("2002-01-01").cast("timestamp_ntz"))
    return out.select("k", "priority", F.col("end_at").isNull().alias("is_current"), "days_active")


@query("b14_current", f"SELECT k, priority FROM ({_SCD2_SQL}) WHERE end_at IS NULL")
def b14_current(spark, sf):
    return hi.current(_history(spark, sf)).select("k", "priority")


@query("b15_join_as_of", f"""
  SELECT f.o_orderkey, h.priority FROM (SELECT o_orderkey, o_custkey AS k, o_orderdate + INTERVAL 15 DAY AS seen FROM orders) f
  LEFT JOIN ({_SCD2_SQL}) h ON h.k = f.k AND h.start_at <= f.seen AND (h.end_at IS NULL OR h.end_at > f.seen)""")
def b15(spark, sf):
    facts = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.timestamp_add("DAY", F.lit(15), F.col("o_orderdate")).alias("seen"))
    return hi.join_as_of(facts, _history(spark, sf), ["k"], "seen").select("o_orderkey", "priority")


@query("b16_merge_upsert", """
  WITH t AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer),
    s AS (SELECT o_custkey AS c_custkey, max(o_orderpriority) AS c_mktsegment, round(sum(o_totalprice), 2) AS c_acctbal, bool_or(o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS gone FROM orders GROUP BY o_custkey)
  SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM s) UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal FROM s WHERE NOT gone""")
def b16(spark, sf):
    target = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    source = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderpriority").alias("c_mktsegment"), F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"),
        F.bool_or((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0)).alias("gone"),
    )
    return hi.merge_upsert(target, source, ["c_custkey"], F.col("gone"))


# ---------------------------------------------------------------- measures


@query("b17_measures", """
  SELECT r_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS open_value,
    round(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 6) AS urgent_share
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def b17(spark, sf):
    star = (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return star.groupBy("r_name", "c_mktsegment").agg(
        F.count("*").alias("orders"), F.round(F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), 2).alias("open_value"),
        F.round(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)) / F.count("*"), 6).alias("urgent_share"),
    )


@query("b18_daily_measures", f"""
  WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1)
  SELECT strftime(day, '{D}') AS day, round(total, 2) AS total, round(sum(total) OVER (ORDER BY day), 2) AS running_total,
    round(sum(total) OVER (ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 2) AS trailing_total,
    round(total - sum(total) OVER (ORDER BY day RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 2) AS day_over_day,
    round(sum(total) OVER (PARTITION BY year(day) ORDER BY day), 2) AS year_to_date FROM d""")
def b18(spark, sf):
    out = hi.daily_measures(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return out.select(day("day").alias("day"), *[F.round(c, 2).alias(c) for c in out.columns if c != "day"])


_RUNNING_SQL = "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running_total FROM orders"


@query("b18_running_total", _RUNNING_SQL)
def b18_running(spark, sf):
    out = running(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], {"running_total": F.col("o_totalprice")}, F.year("o_orderdate"))
    return out.select("o_orderkey", F.round("running_total", 2).alias("running_total"))


@query("b18_running_total_hot", _RUNNING_SQL)
def b18_running_hot(spark, sf):
    # Fine slices: hardly any holds two rows of a key.
    out = running(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], {"running_total": F.col("o_totalprice")}, F.to_date("o_orderdate"))
    return out.select("o_orderkey", F.round("running_total", 2).alias("running_total"))


@query("b18_trailing_distinct", f"""
  WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events)
  SELECT strftime(a.day, '{D}') AS day, count(DISTINCT b.user_id) AS distinct_values FROM (SELECT DISTINCT day FROM d) a
  JOIN d b ON b.day BETWEEN a.day - INTERVAL 6 DAY AND a.day GROUP BY a.day""")
def b18_distinct(spark, sf):
    out = hi.trailing_distinct(table(spark, sf, "events"), "ts", "user_id", 7)
    return out.select(day("day").alias("day"), "distinct_values")


@query("b19_last_value", f"SELECT user_id, strftime(ts, '%Y-%m') AS month, arg_max(value, (ts, event_id)) AS closing_value, count(*) AS n FROM events GROUP BY 1, 2")
def b19(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("closing_value"), F.count("*").alias("n")
    )


def _sets_query(name: str, clause: str, build) -> None:
    @query(f"b20_{name}", f"""
      SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY {clause}""")
    def run(spark, sf):
        return build(table(spark, sf, "lineitem")).agg(
            F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")
        )


_LI = ("l_returnflag", "l_linestatus")
_sets_query("rollup", "ROLLUP (l_returnflag, l_linestatus)", lambda d: d.rollup(*_LI))
_sets_query("cube", "CUBE (l_returnflag, l_linestatus)", lambda d: d.cube(*_LI))
_sets_query("grouping_sets", "GROUPING SETS ((l_returnflag), (l_linestatus))", lambda d: d.groupingSets([["l_returnflag"], ["l_linestatus"]], *_LI))


@query("b21_usage_cost", """
  SELECT p_type, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS lines,
    round(sum(l_quantity * p_retailprice), 2) AS cost FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def b21(spark, sf):
    bucket = F.when(F.col("l_quantity") < 10, "small").when(F.col("l_quantity") < 30, "medium").otherwise("large")
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_type", bucket.alias("bucket")).agg(
        F.count("*").alias("lines"), F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("cost")
    )


@query("b21_moving_average", f"""
  SELECT event_type, strftime(day, '{D}') AS day, round(avg(total) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS moving_avg
  FROM (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS total FROM events GROUP BY 1, 2)""")
def b21_moving(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-6, 0)
    return daily.select("event_type", day("day").alias("day"), F.round(F.avg("total").over(w), 6).alias("moving_avg"))


@query("b22_activity", "SELECT user_id, count(*) AS events, count(DISTINCT CAST(ts AS DATE)) AS active_days, CAST(count_if(event_type = 'error') AS BIGINT) AS failures, round(sum(value), 4) AS total FROM events GROUP BY user_id ORDER BY events DESC, user_id LIMIT 20")
def b22(spark, sf):
    out = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("events"), F.countDistinct(F.to_date("ts")).alias("active_days"),
        F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("failures"), F.round(F.sum("value"), 4).alias("total"),
    )
    return out.orderBy(F.col("events").desc(), "user_id").limit(20)


@query("b22_failures_by_message", "SELECT json_extract_string(props, '$.k') AS message, event_type, count(*) AS n, round(avg(value), 6) AS mean_duration FROM events GROUP BY 1, 2")
def b22_failures(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.get_json_object("props", "$.k").alias("message"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_duration"))


# ---------------------------------------------------------------- quality of rows

_RULE_SQL = {"has_key": "o_custkey IS NOT NULL", "positive": "o_totalprice >= 0", "known": "o_custkey >= 0"}


def _rules():
    return {"has_key": F.col("o_custkey").isNotNull(), "positive": F.col("o_totalprice") >= 0, "known": F.col("o_custkey") >= 0}


_BROKEN_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({s}, false) THEN '{n}' END" for n, s in _RULE_SQL.items()) + "], lambda x: x IS NOT NULL), ',')"


@query("b23_expect_warn", f"SELECT o_orderkey, {_BROKEN_SQL} AS failed_rules FROM ({_FAULTY_SQL})")
def b23(spark, sf):
    out = qu.with_expectations(_faulty(spark, sf), _rules())
    return out.select("o_orderkey", F.array_join("failed_rules", ",").alias("failed_rules"))


@query("b23_expect_drop", f"SELECT o_orderkey, o_custkey FROM ({_FAULTY_SQL}) WHERE " + " AND ".join(_RULE_SQL.values()))
def b23_drop(spark, sf):
    return qu.drop_failing(_faulty(spark, sf), _rules()).select("o_orderkey", "o_custkey")


@query("b23_expect_fail", "SELECT o_orderkey, o_custkey FROM orders")
def b23_fail(spark, sf):
    return qu.fail_on(table(spark, sf, "orders"), _rules()).select("o_orderkey", "o_custkey")


@query("b23_expect_counts", " UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(count_if(coalesce({s}, false)) AS BIGINT) AS passed, CAST(count_if(NOT coalesce({s}, false)) AS BIGINT) AS failed FROM ({_FAULTY_SQL})" for n, s in _RULE_SQL.items()))
def b23_counts(spark, sf):
    return qu.expectation_counts(_faulty(spark, sf), _rules())


_RAW_SQL = "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN left(props, 4) WHEN event_id % 10 = 1 THEN '{\"k\": \"many\"}' ELSE props END AS raw FROM events"
_BAD_SQL = "event_id % 10 < 2"


def _parsed(spark, sf):
    raw = (
        F.when(F.col("event_id") % 10 == 0, F.left(F.col("props"), F.lit(4))).when(F.col("event_id") % 10 == 1, '{"k": "many"}')
        .otherwise(F.col("props"))
    )
    return qu.parse_or_rescue(table(spark, sf, "events").select("event_id", raw.alias("raw")), "raw", "k bigint")


@query("b24_rescue", f"SELECT event_id, CASE WHEN NOT {_BAD_SQL} THEN CAST(json_extract_string(CASE WHEN {_BAD_SQL} THEN NULL ELSE raw END, '$.k') AS BIGINT) END AS k, CASE WHEN {_BAD_SQL} THEN raw END AS rescued FROM ({_RAW_SQL})")
def b24(spark, sf):
    return _parsed(spark, sf).select("event_id", F.col("parsed.k").alias("k"), "rescued")


_WORDS_SQL = "SELECT unnest(list_filter(string_split_regex(text, '[^\\p{L}]+'), lambda t: t <> '')) AS w FROM documents"


@query("b25_collation", f"SELECT min(w) AS word, count(*) AS n, count(DISTINCT w) AS forms FROM ({_WORDS_SQL}) GROUP BY replace(strip_accents(lower(w)), 'ß', 'ss')")
def b25(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", r"[^\p{L}]+")).alias("w")).where("w <> ''")
    # Equal forms are counted first, so the costly comparison sees each once.
    forms = words.groupBy("w").agg(F.count("*").alias("n"))
    return forms.groupBy(F.collate("w", "UNICODE_CI_AI").alias("g")).agg(
        F.min("w").alias("word"), F.sum("n").cast("bigint").alias("n"), F.count("*").alias("forms")
    ).drop("g")


def _mask_sql(x: str) -> str:
    for p in PII_PATTERNS.values():
        x = f"regexp_replace({x}, '{p}', '[MASKED]', 'g')"
    return x


@query("b26_mask_pii", f"SELECT doc_id, md5({_mask_sql('text')}) AS digest FROM documents")
def b26(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(mask_pii(F.col("text"))).alias("digest"))


# The SQL engine compares bytes, so each accented letter becomes one capital first.
def _vocab_sql(t: str) -> str:
    return f"""SELECT w, translate(w, 'äöüßéèêçàâîôûëïùœæñíóúáìò', 'ABCDEFGHIJKLMNOPQRSTUVWXY') AS t, length(w) AS n
      FROM (SELECT DISTINCT unnest({sql_tokens('text')}) AS w FROM {t})"""


@query("b27_fuzzy_join", f"""
  SELECT l.w AS left_value, r.w AS right_value, CAST(levenshtein(l.t, r.t) AS INTEGER) AS distance, round(1 - levenshtein(l.t, r.t) / greatest(l.n, r.n), 6) AS score
  FROM ({_vocab_sql('benchmark')}) l JOIN ({_vocab_sql('documents')}) r ON abs(l.n - r.n) <= 1 AND levenshtein(l.t, r.t) <= CASE WHEN greatest(l.n, r.n) >= 5 THEN 1 ELSE 0 END""")
def b27(spark, sf):
    vocab = lambda t: text_table(spark, sf, t).select(F.explode(tokens(F.col("text"))).alias("w"))
    # A score of 0.8 with one edit means words of five letters and more.
    return rel.fuzzy_join(vocab("benchmark"), vocab("documents"), "w", "w", 1, 0.8).withColumn("score", F.round("score", 6))


@query("b28_forecast", f"""
  SELECT event_type, strftime(DATE '1970-01-01' + CAST(last + h AS INTEGER), '{D}') AS day, round(b + s * (last + h), 4) AS forecast,
    round(b + s * (last + h) - 1.96e0 * sd, 4) AS lower, round(b + s * (last + h) + 1.96e0 * sd, 4) AS upper FROM (
    SELECT event_type, regr_slope(y, x) AS s, regr_intercept(y, x) AS b, max(x) AS last, sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / (count(*) - 2)) AS sd
    FROM (SELECT event_type, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS DOUBLE) AS x, sum(value) AS y FROM events GROUP BY 1, 2) GROUP BY event_type), unnest(range(1, 8)) AS g(h)""")
def b28(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    out = rel.forecast(daily, ["event_type"], "day", "total", 7)
    return out.select("event_type", day("day").alias("day"), *[F.round(c, 4).alias(c) for c in ("forecast", "lower", "upper")])


@query("b29_error_table", f"SELECT event_id, 'bad props' AS error, raw FROM ({_RAW_SQL}) WHERE {_BAD_SQL}")
def b29(spark, sf):
    staged = _parsed(spark, sf).withColumn("error", F.when(F.col("rescued").isNotNull(), "bad props"))
    return qu.split_errors(staged, "error")[1].select("event_id", "error", "raw")


# ---------------------------------------------------------------- traces

# A trace per 16 events; within it, span i hangs below span (i - 1) // 2.
_SPANS_SQL = """
  SELECT event_id // 16 AS trace_id, event_id AS span_id, CASE WHEN event_id % 16 > 0 THEN event_id // 16 * 16 + (event_id % 16 - 1) // 2 END AS parent_id,
    CASE event_id % 3 WHEN 0 THEN 'LLM' WHEN 1 THEN 'TOOL' ELSE 'CHAIN' END AS span_type, event_type AS name, value AS duration_ms, user_id,
    CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
    CASE WHEN user_id % 9 = 0 THEN '' ELSE props END AS output FROM events"""


def _spans(spark, sf):
    i = F.col("event_id") % 16
    return table(spark, sf, "events").select(
        F.expr("event_id div 16").alias("trace_id"), F.col("event_id").alias("span_id"),
        F.when(i > 0, F.expr("event_id div 16 * 16 + (event_id % 16 - 1) div 2")).alias("parent_id"),
        F.when(F.col("event_id") % 3 == 0, "LLM").when(F.col("event_id") % 3 == 1, "TOOL").otherwise("CHAIN").alias("span_type"),
        F.col("event_type").alias("name"), F.col("value").alias("duration_ms"), "user_id",
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        F.when(F.col("user_id") % 9 == 0, "").otherwise(F.col("props")).alias("output"),
    )


@query("b30_span_tree", f"""
  WITH RECURSIVE s AS (SELECT trace_id, span_id, parent_id FROM ({_SPANS_SQL})),
    t AS (SELECT *, 0 AS depth FROM s WHERE parent_id IS NULL UNION ALL SELECT s.*, t.depth + 1 FROM s JOIN t ON s.trace_id = t.trace_id AND s.parent_id = t.span_id)
  SELECT t.*, (SELECT count(*) FROM s WHERE s.parent_id = t.span_id) AS children FROM t""")
def b30(spark, sf):
    return tr.span_tree(_spans(spark, sf))


@query("b31_latency_by_type", f"SELECT span_type, name, count(*) AS spans, round(sum(duration_ms), 4) AS total_ms, round(avg(duration_ms), 6) AS mean_ms FROM ({_SPANS_SQL}) GROUP BY 1, 2")
def b31(spark, sf):
    return tr.latency_by(_spans(spark, sf), ["span_type", "name"]).withColumns({"total_ms": F.round("total_ms", 4), "mean_ms": F.round("mean_ms", 6)})


@query("b32_bottlenecks", f"""
  SELECT trace_id, CAST(r AS INTEGER) AS rank, span_id, name, duration_ms, round(duration_ms / total, 6) AS share FROM (
    SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY duration_ms DESC, span_id) AS r, sum(duration_ms) OVER (PARTITION BY trace_id) AS total FROM ({_SPANS_SQL})) WHERE r <= 3""")
def b32(spark, sf):
    return tr.bottlenecks(_spans(spark, sf), 3).withColumn("share", F.round("share", 6))


@query("b33_span_errors", f"SELECT span_type, fault, count(*) AS spans, count(DISTINCT trace_id) AS traces FROM (SELECT *, CASE WHEN status = 'ERROR' THEN 'failed' WHEN output = '' THEN 'empty_output' END AS fault FROM ({_SPANS_SQL})) WHERE fault IS NOT NULL GROUP BY 1, 2")
def b33(spark, sf):
    return tr.span_errors(_spans(spark, sf))


@query("b34_call_stats", f"SELECT span_type, name, count(*) AS calls, round(avg(CASE WHEN status = 'OK' THEN 1.0e0 ELSE 0.0e0 END), 6) AS success_rate, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(duration_ms), 6) AS mean_ms FROM ({_SPANS_SQL}) WHERE span_type IN ('LLM', 'TOOL') GROUP BY 1, 2")
def b34(spark, sf):
    return tr.call_stats(_spans(spark, sf), ["LLM", "TOOL"]).withColumns({"success_rate": F.round("success_rate", 6), "mean_ms": F.round("mean_ms", 6)})


@query("b35_compare_sets", f"""
  SELECT trace_set, count(*) AS traces, round(avg(ms), 6) AS mean_ms, round(min(ms), 6) AS min_ms, round(max(ms), 6) AS max_ms, round(avg(ok), 6) AS success_rate, round(quantile_cont(ms, 0.5), 6) AS p50_ms FROM (
    SELECT CASE WHEN trace_id % 2 = 0 THEN 'even' ELSE 'odd' END AS trace_set, trace_id, sum(duration_ms) AS ms, min(CASE WHEN status = 'OK' THEN 1.0e0 ELSE 0.0e0 END) AS ok FROM ({_SPANS_SQL}) GROUP BY 1, 2) GROUP BY 1""")
def b35(spark, sf):
    out = tr.compare_sets(_spans(spark, sf), F.when(F.col("trace_id") % 2 == 0, "even").otherwise("odd"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_ms", "min_ms", "max_ms", "success_rate", "p50_ms")})


@query("b36_failing_cases", "SELECT event_id AS trace_id, 'click' AS scorer, 'no' AS value FROM events WHERE event_id % 2 = 0 AND event_id % 4 <> 0 AND event_type = 'click'")
def b36(spark, sf):
    return tr.failing_cases(assessed_traces(spark, sf), "click")
