"""Runs registered queries and their SQL twins side by side: ``python tests/compare.py [sf] [name-prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from gridsieve.queries import ORACLES, QUERIES  # noqa: E402
from gridsieve.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return str(value)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canon(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str):
    """Returns (ok, message, seconds)."""
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(x) for x in df.collect()]
    took = time.time() - start
    if name not in ORACLES:
        return bool(rows), f"rows only: {len(rows)}", took
    rel = con.execute(ORACLES[name])
    want_names = [x[0] for x in rel.description]
    got_n, got = sorted_rows(df.columns, rows)
    want_n, want = sorted_rows(want_names, rel.fetchall())
    if got_n != want_n:
        return False, f"columns {got_n} != {want_n}", took
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return False, f"{len(got)} vs {len(want)} rows; only spark {extra}; only sql {missing}", took
    return True, f"{len(got)} rows", took


def main():
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    prefixes = tuple(args[1:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            ok, message, took = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            ok, message, took = False, f"{type(e).__name__}: {str(e)[:700]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:40s} {took:6.2f}s {message}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
