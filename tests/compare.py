"""Run registered queries against their reference SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v + 0.0 if v != 0 else 0.0) if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(canon(r[i])) for i in order) for r in records)


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def oracle_rows(con, sql):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def check(spark, con, fn, sql, folder):
    cols, recs = spark_rows(fn(spark, folder))
    if sql is None:
        return None, f"{len(recs)} rows (no oracle)"
    ocols, orecs = oracle_rows(con, sql)
    if sorted(cols) != sorted(ocols):
        return False, f"columns {sorted(cols)} != {sorted(ocols)}"
    a, b = rows_of(cols, recs), rows_of(ocols, orecs)
    if len(a) != len(b):
        return False, f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)}/{len(a)} rows differ {sorted(cols)}: {bad[:2]}"
    return True, f"{len(a)} rows"


def main(argv):
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
    import __spark_entry__ as entry
    from tests.session import local_session

    sf = argv[0]
    names = argv[1:]
    spark = local_session()
    folder = f"{ROOT}/sf{sf}"
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    fails = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            ok, msg = check(spark, con, fn, oracles.get(name), folder)
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        fails += ok is False
        print(f"{'FAIL' if ok is False else 'ok' if ok else 'rows'}\t{name}\t{time.time() - start:.1f}s\t{msg}", flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    main(sys.argv[1:])
