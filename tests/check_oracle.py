"""Run registered queries beside their SQL on the same tables and compare.

    python tests/check_oracle.py [sf] [name prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}" if not v.is_integer() else str(int(v))
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T", " ")
    return str(v)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_notes(got, con, sql):
    """Columns whose SQL type is not the plain counterpart of the Spark type."""
    have = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [(n, t, have.get(n)) for n, t in got.dtypes if TYPES.get(t) != have.get(n)]


def compare(spark, con, fn, sql, sf_dir):
    got = fn(spark, sf_dir)
    cols = sorted(got.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in got.collect())
    if sql is None:
        return "rows", len(rows), 0, []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return "SCHEMA", len(rows), 0, [(cols, sorted(names))]
    at = {n: i for i, n in enumerate(names)}
    want = sorted(tuple(norm(r[at[c]]) for c in cols) for r in cur.fetchall())
    if rows == want:
        return "ok", len(rows), len(want), [("types", t) for t in type_notes(got, con, sql)]
    diff = [("spark", r) for r in sorted(set(rows) - set(want))[:3]] + [("sql", r) for r in sorted(set(want) - set(rows))[:3]]
    return "DIFF", len(rows), len(want), diff


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def main():
    import __spark_entry__ as entry
    from docsieve.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            status, n, m, diff = compare(spark, con, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            status, n, m, diff = "ERROR", 0, 0, [str(e)[:900]]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        warn = " EMPTY" if n == 0 and status in ("ok", "rows") else ""
        if status not in ("ok", "rows"):
            bad += 1
        print(f"{status:6} {name:34} spark={n} sql={m} {time.time() - t:.1f}s{warn}", flush=True)
        for d in diff:
            print("      ", str(d)[:900])
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
