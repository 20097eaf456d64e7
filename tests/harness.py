"""Run registered queries and compare them with their DuckDB twins."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        if math.isnan(value):
            return (2, "nan")
        return (3, f"{value:.9g}" if value else "0")
    if isinstance(value, int):
        return (3, f"{float(value):.9g}" if abs(value) < 2 ** 53 else str(value))
    if isinstance(value, dt.datetime):
        return (4, value.replace(tzinfo=None).isoformat())
    return (5, str(value))


def _kinds(rows, width):
    kinds = []
    for i in range(width):
        kinds.append(sorted({type(r[i]).__name__ for r in rows if r[i] is not None}))
    return kinds


def check(spark, con, folder, name, fn, sql):
    """Return ``(status, seconds, detail)``."""
    start = time.time()
    df = fn(spark, folder)
    rows = df.collect()
    seconds = time.time() - start
    if sql is None:
        return "rows", seconds, f"{len(rows)} rows"
    cur = con.execute(sql)
    twin_cols = [d[0] for d in cur.description]
    twin_rows = cur.fetchall()
    cols = sorted(df.columns)
    if cols != sorted(twin_cols):
        return "columns", seconds, f"{cols} != {sorted(twin_cols)}"
    left_idx = [df.columns.index(c) for c in cols]
    right_idx = [twin_cols.index(c) for c in cols]
    left_rows = [tuple(r[i] for i in left_idx) for r in rows]
    right_rows = [tuple(r[i] for i in right_idx) for r in twin_rows]
    left = sorted([tuple(_cell(v) for v in r) for r in left_rows])
    right = sorted([tuple(_cell(v) for v in r) for r in right_rows])
    if left != right:
        only_l = [x for x in left if x not in set(right)][:3]
        only_r = [x for x in right if x not in set(left)][:3]
        return "values", seconds, f"{len(left)} vs {len(right)} rows; cols {cols}\n   spark {only_l}\n   duck  {only_r}"
    lk, rk = _kinds(left_rows, len(cols)), _kinds(right_rows, len(cols))
    if lk != rk:
        return "types", seconds, str([(c, a, b) for c, a, b in zip(cols, lk, rk) if a != b])
    return ("ok" if rows else "empty"), seconds, f"{len(rows)} rows"


def main(argv):
    import os

    import __spark_entry__ as entry
    from tallyloom.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = local_session()
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    times = {}
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        try:
            status, seconds, detail = check(spark, con, folder, name, fn, oracle.get(name))
        except Exception as exc:  # report and go on
            status, seconds, detail = "ERROR", 0.0, str(exc)[:400]
        times[name] = seconds
        if status not in ("ok", "rows"):
            bad += 1
            print(f"{status:8} {name} {seconds:.2f}s {detail}", flush=True)
        elif os.environ.get("V"):
            print(f"{status:8} {name} {seconds:.2f}s {detail}", flush=True)
    print(f"{len(times)} run, {bad} bad; slowest {sorted(times.items(), key=lambda kv: -kv[1])[:12]}")


if __name__ == "__main__":
    main(sys.argv[1:])
