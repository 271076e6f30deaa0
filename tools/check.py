"""Runs registered queries against their SQL counterparts and reports differences.

usage: python tools/check.py [--sf 0.01] [--explain] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import signal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from netsift.plans import catalog, inputs  # noqa: E402
from netsift.session import local_session  # noqa: E402


def too_slow(*_):
    raise TimeoutError("query took too long")


signal.signal(signal.SIGALRM, too_slow)


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("--module")
    parser.add_argument("--limit", type=int, default=60)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    if args.module:
        catalog.MODULES[:] = args.module.split(",")
    catalog.load()
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    base = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for name in inputs.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{base}/{name}.parquet'")
    names = args.names or list(catalog.QUERIES)
    bad = []
    for name in names:
        started = time.time()
        signal.alarm(args.limit)
        try:
            df = catalog.QUERIES[name](spark, base)
            if args.explain:
                df.explain("formatted")
            got = rows_of(df.columns, df.collect())
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark {type(exc).__name__}: {str(exc)[:700]}", flush=True)
            bad.append(name)
            spark.sparkContext.cancelAllJobs()
            continue
        spent = time.time() - started
        sql = catalog.ORACLES.get(name)
        if sql is None:
            print(f"rows {name}: {len(got)} rows {spent:.1f}s", flush=True)
            continue
        try:
            result = con.execute(sql)
            columns = [c[0] for c in result.description]
            want = rows_of(columns, result.fetchall())
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: sql {str(exc)[:700]}", flush=True)
            bad.append(name)
            continue
        signal.alarm(0)
        if sorted(columns) != sorted(df.columns):
            print(f"FAIL {name}: columns {sorted(df.columns)} vs {sorted(columns)}", flush=True)
            bad.append(name)
        elif got != want:
            bad.append(name)
            print(f"FAIL {name}: {len(got)} vs {len(want)} rows, columns {sorted(columns)}", flush=True)
            for a in [r for r in got if r not in set(want)][:2]:
                print("   spark", a)
            for b in [r for r in want if r not in set(got)][:2]:
                print("   sql  ", b)
        else:
            note = "" if got else " EMPTY"
            print(f"ok   {name}: {len(got)} rows {spent:.1f}s{note}", flush=True)
    print(f"{len(names)} queries, {len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
