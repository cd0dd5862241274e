"""Run catalog queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive hash of values.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 9))
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as ent
    qs, sqls = ent.queries(), ent.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("spark_error", str(e)[:400])
            if verbose:
                print(f"{name:24s} SPARK ERROR {str(e)[:400]}")
            continue
        ts = time.time() - t
        if name not in sqls:
            results[name] = ("rows_only", len(rows))
            if verbose:
                print(f"{name:24s} rows-only {len(rows)} ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [c[0] for c in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("sql_error", str(e)[:400])
            if verbose:
                print(f"{name:24s} SQL ERROR {str(e)[:400]}")
            continue
        h1, l1 = digest(rows, cols)
        h2, l2 = digest(drows, dcols)
        ok = sorted(cols) == sorted(dcols) and len(rows) == len(drows) and h1 == h2
        results[name] = ("ok" if ok else "mismatch", len(rows), len(drows))
        if verbose:
            print(f"{name:24s} {'OK ' if ok else 'BAD'} spark={len(rows)} duck={len(drows)} ({ts:.1f}s)")
            if not ok:
                if sorted(cols) != sorted(dcols):
                    print("   cols", sorted(cols), sorted(dcols))
                a, b = set(l1), set(l2)
                print("   spark-only", sorted(a - b)[:3])
                print("   duck-only ", sorted(b - a)[:3])
    return results


if __name__ == "__main__":
    from spanloom.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v[0] not in ("ok", "rows_only")]
    print("BAD:", bad)
