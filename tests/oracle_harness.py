"""Run a registered query on Spark and its oracle SQL on DuckDB and compare
(row count, column names, order-insensitive values). Usable from pytest
and from the command line: ``python tests/oracle_harness.py [keys...]``."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 4)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, key, sf_dir, queries, sqls, con=None):
    con = con or duck(sf_dir)
    t = time.time()
    sdf = queries[key](spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    ts = time.time() - t
    if key not in sqls:
        return {"key": key, "rows": len(s_rows), "oracle": None, "spark_sec": round(ts, 2)}
    res = con.execute(sqls[key])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    out = {"key": key, "rows": len(s_rows), "oracle_rows": len(d_rows), "cols": ok_cols,
           "values": a == b, "spark_sec": round(ts, 2)}
    if not (ok_cols and a == b):
        out["spark_cols"], out["oracle_cols"] = sorted(s_cols), sorted(d_cols)
        sa, sb = set(a), set(b)
        out["only_spark"] = list(sa - sb)[:5]
        out["only_oracle"] = list(sb - sa)[:5]
    return out


if __name__ == "__main__":
    from figureproof.session import get_spark
    import __spark_entry__ as E
    sf = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    qs, sq = E.queries(), E.oracle_sql()
    keys = sys.argv[1:] or list(qs)
    con = duck(sf)
    for k in keys:
        try:
            print(compare(spark, k, sf, qs, sq, con), flush=True)
        except Exception as e:  # report and continue
            print({"key": k, "error": repr(e)[:600]}, flush=True)
