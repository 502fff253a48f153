"""Runs queries beside their SQL on DuckDB: python tests/oracle.py DIR [NAME...]"""

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(d: str):
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or (not isinstance(v, (list, tuple, np.ndarray, dict)) and pd.isna(v)):
            return "~"
        if isinstance(v, (float, np.floating)):
            return f"{v:.6g}"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, np.integer)):
            return f"{float(v):.6g}" if abs(v) < 2**40 else str(int(v))
        if isinstance(v, (list, tuple, np.ndarray)):
            return "[" + ",".join(map(one, v)) + "]"
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        return str(v)

    df = df[sorted(df.columns)]
    out = pd.DataFrame({c: [one(v) for v in df[c]] for c in df.columns})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def compare(spark, d, name, entry) -> str:
    t = time.time()
    got = entry.queries()[name](spark, d).toPandas()
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if not sql:
        return f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    want = views(d).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: DIFFERENT columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a.equals(b):
        return f"{name}: equal, {len(a)} rows, {took:.1f} s"
    m = a.merge(b, how="outer", indicator=True)
    return f"{name}: DIFFERENT {len(a)} {len(b)} rows\n{m[m._merge != 'both'].head(8).to_string()}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from vigilark.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(entry.queries())
    for n in names:
        try:
            print(compare(spark, sys.argv[1], n, entry), flush=True)
        except Exception as e:
            print(f"{n}: FAILED {str(e)[:1500]}", flush=True)
