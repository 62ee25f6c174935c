"""Run registered queries on Spark and their check SQL in DuckDB, compare every value.

python tests/oracle.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(directory: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, repr(v + 0.0))
    return (3, str(v))


def _rows(rows, order):
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def compare(df, con, sql: str) -> str:
    """'' when equal, otherwise the first difference."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_types = {n: TYPES.get(t, t) for n, t in df.dtypes}
    duck_types = {n: str(t) for n, t in zip(names, [c[1] for c in cur.description], strict=True)}
    diff = {n: (spark_types[n], duck_types[n]) for n in names if spark_types[n] != duck_types[n]}
    if diff:
        return f"types differ (spark, duckdb): {diff}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} expected"
    cols = sorted(names)
    a = _rows(got, [df.columns.index(c) for c in cols])
    b = _rows(want, [names.index(c) for c in cols])
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        x, y = bad[0]
        return f"{len(bad)} of {len(a)} rows differ, first: " + str(
            {c: (p[1], q[1]) for c, p, q in zip(cols, x, y, strict=True) if p != q})
    return "" if got else "no rows"


def main() -> int:
    from tenuria.plans import catalog
    from tenuria.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    directory = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(), connect(directory)
    queries, checks = catalog.queries(), catalog.oracle_sql()
    failed = 0
    for key in args.keys or queries:
        start = time.time()
        try:
            df = queries[key](spark, directory)
            if key in checks:
                message = compare(df, con, checks[key])
                status = f"FAIL {message}" if message else "ok"
            else:
                status = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001 - report and go on
            status = f"ERROR {str(e)[:700]}"
        failed += status.startswith(("FAIL", "ERROR"))
        print(f"{key:32s} {time.time() - start:6.2f}s {status}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
