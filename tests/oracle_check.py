"""Spark-vs-DuckDB comparison used by the tests and runnable by hand.

    python tests/oracle_check.py [sf_dir] [name ...]

Compares row count, column names and an order-insensitive value hash of
``queries()[name]`` against ``oracle_sql()[name]``.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    return repr(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(str(_norm(r[i])) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark, con, name: str, sf_dir: str):
    import __spark_entry__ as e
    t0 = time.time()
    sdf = e.queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = con.execute(e.oracle_sql()[name])
    ocols = [c[0] for c in res.description]
    otypes = {c[0]: str(c[1]) for c in res.description}
    orows = res.fetchall()
    sh, sl = digest(scols, srows)
    oh, ol = digest(ocols, orows)
    ok = sorted(scols) == sorted(ocols) and len(srows) == len(orows) and sh == oh
    detail = ""
    type_diff = [f"{n}:{t}/{otypes.get(n)}" for n, t in sdf.dtypes
                 if SPARK_TO_DUCK.get(t, t) != otypes.get(n)]
    if type_diff:
        ok = False
        detail = f"types {type_diff} "
    if not ok:
        if sorted(scols) != sorted(ocols):
            detail += f"columns spark={sorted(scols)} oracle={sorted(ocols)}"
        else:
            diff_s = sorted(set(sl) - set(ol))[:3]
            diff_o = sorted(set(ol) - set(sl))[:3]
            detail += f"rows spark={len(srows)} oracle={len(orows)}; spark-only={diff_s}; oracle-only={diff_o}"
    return ok, len(srows), t1 - t0, detail


if __name__ == "__main__":
    from augsight.session import get_session
    import __spark_entry__ as e
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = args or sorted(e.oracle_sql())
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            ok, rows, secs, detail = compare(spark, con, n, sf_dir)
        except Exception as ex:  # report and continue
            ok, rows, secs, detail = False, -1, 0.0, f"{type(ex).__name__}: {str(ex)[:300]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:32s} rows={rows:7d} {secs:6.2f}s {detail}", flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
