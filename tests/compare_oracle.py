"""Run every registered query on Spark and its oracle SQL on DuckDB and
compare row multisets (a local stand-in for the driver's check).

usage: python tests/compare_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

# Spark type -> DuckDB type of the same values
TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
            "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    from churnlens.session import local_session
    import __spark_entry__ as E

    spark = local_session()
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            cols = sorted(sdf.columns)
            srows = [tuple(norm(r[c]) for c in cols) for r in sdf.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:300]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"----  {name}: rows={len(srows)} (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            rel = con.sql(sqls[name])
            dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            raw = cur.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:300]}")
            bad += 1
            continue
        if sorted(dcols) != cols:
            print(f"FAIL {name}: columns spark={cols} duck={sorted(dcols)}")
            bad += 1
            continue
        type_diff = [f"{c}: spark={t} duck={dtypes.get(c)}" for c, t in sdf.dtypes
                     if TYPE_MAP.get(t, t.upper()) != dtypes.get(c)]
        if type_diff:
            print(f"FAIL {name}: types {type_diff}")
            bad += 1
            continue
        idx = [dcols.index(c) for c in cols]
        drows = [tuple(norm(r[i]) for i in idx) for r in raw]
        ok = sorted(srows, key=key) == sorted(drows, key=key)
        status = "ok  " if ok else "FAIL"
        if not ok:
            bad += 1
        print(f"{status} {name}: rows spark={len(srows)} duck={len(drows)} {t1 - t0:.1f}s")
        if not ok:
            ss, dd = set(srows), set(drows)
            print("   spark-only:", sorted(ss - dd, key=key)[:3])
            print("   duck-only: ", sorted(dd - ss, key=key)[:3])
    spark.stop()
    print(f"{bad} failing of {len(names or qs)}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
