"""Side-by-side run of registered queries and their SQL (also a script).

    python tests/oracle.py [names...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v, digits):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) + 0.0
    return v


def rows_of(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_cell(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, sf_dir, digits=9):
    """(equal, message, spark seconds, bit-equal)"""
    import __spark_entry__ as e

    t0 = time.time()
    df = e.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    dt = time.time() - t0
    sql = e.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL", dt, True
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}", dt, False
    a, b = rows_of(df.columns, got, digits), rows_of(cols, want, digits)
    if a == b:
        exact = rows_of(df.columns, got, 17) == rows_of(cols, want, 17)
        return True, f"{len(a)} rows", dt, exact
    bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"{len(a)} vs {len(b)} rows; {bad}; cols {sorted(cols)}", dt, False


if __name__ == "__main__":
    from sightline.session import build_session

    import __spark_entry__ as e

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    names = sys.argv[1:] or list(e.queries())
    for n in names:
        try:
            ok, msg, dt, exact = compare(spark, con, n, sf)
        except Exception as err:  # report and go on
            ok, msg, dt, exact = False, f"{type(err).__name__}: {str(err)[:1500]}", 0.0, False
        print(f"{'OK  ' if ok else 'FAIL'} {n:32s} {dt:6.2f}s {'bit' if exact else 'approx'} {msg}", flush=True)
