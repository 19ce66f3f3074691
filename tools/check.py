"""Run registered queries next to their SQL in DuckDB and report differences.

usage: python tools/check.py [--sf DIR] [--show] [--explain] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KIND = {
    "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    import datetime as dt
    import math

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
    return a == b


def compare(spark, con, q, sf: str) -> tuple[str, str, float]:
    t0 = time.time()
    df = q.run(spark, sf)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    cols = df.columns
    if q.sql is None:
        return "rows", f"{len(rows)} rows", took
    cur = con.execute(q.oracle().replace("'/root/testdata/sf0.01/", f"'{sf}/"))  # SQL that reads files names the folder
    ocols = [x[0] for x in cur.description]
    orows = cur.fetchall()
    if sorted(cols) != sorted(ocols):
        return "FAIL", f"columns {sorted(set(cols) ^ set(ocols))}", took
    otypes = {x[0]: str(x[1]).upper() for x in cur.description}
    stypes = dict(df.dtypes)
    bad = [f"{c}:{stypes[c]}/{otypes[c]}" for c in cols
           if KIND.get(stypes[c]) != {"STRING": "VARCHAR"}.get(otypes[c], otypes[c])]
    names = sorted(cols)
    pick, opick = [cols.index(c) for c in names], [ocols.index(c) for c in names]
    a = sorted((tuple(norm(r[k]) for k in pick) for r in rows), key=repr)
    b = sorted((tuple(norm(r[k]) for k in opick) for r in orows), key=repr)
    note = f"{len(rows)} rows" + (f" TYPES {bad}" if bad else "")
    if len(rows) == 0:
        note += " EMPTY"
    if len(a) != len(b):
        return "FAIL", f"rows {len(a)} vs {len(b)}", took
    miss = [(x, y) for x, y in zip(a, b) if x != y]
    if miss:
        soft = all(all(close(p, r) for p, r in zip(x, y)) for x, y in miss)
        if not soft:
            def key(r):
                return tuple(repr(v) for v in r if not isinstance(v, float))

            a2, b2 = sorted(a, key=key), sorted(b, key=key)
            soft = all(all(close(p, r) for p, r in zip(x, y)) for x, y in zip(a2, b2))
        if not soft:
            sa, sb = set(a), set(b)
            return "FAIL", (f"{len(miss)} of {len(a)} differ\n   cols {names}\n   spark {sorted(sa - sb, key=repr)[:3]}"
                            f"\n   duck  {sorted(sb - sa, key=repr)[:3]}"), took
        note += f" soft({len(miss)})"
    return "ok", note, took


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from tidemark.plans import load
    from tidemark.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    fails = 0
    for name, q in load().items():
        if args.names and not any(name == n or name.startswith(n) for n in args.names):
            continue
        try:
            if args.explain:
                q.run(spark, args.sf).explain("formatted")
            if args.show:
                q.run(spark, args.sf).show(5, truncate=False)
            status, note, took = compare(spark, con, q, args.sf)
        except Exception as e:  # report and go on
            status, note, took = "ERROR", f"{type(e).__name__}: {str(e)[:900]}", 0.0
        fails += status in ("FAIL", "ERROR")
        print(f"{status:5} {took:6.2f}s {name}: {note}", flush=True)
    print("failures:", fails)
    spark.stop()


if __name__ == "__main__":
    main()
