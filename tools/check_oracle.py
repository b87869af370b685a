"""Compare registered queries with their SQL counterparts: python tools/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidestock.session import build_session  # noqa: E402
from tidestock.testbed.registry import oracle_sql, queries  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events"


def cell(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr), [columns[i] for i in order]


def compare(spark, con, name, sf_dir):
    start = time.time()
    df = queries()[name](spark, sf_dir)
    mine, mine_cols = rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    start = time.time()
    rel = con.execute(oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    theirs, their_cols = rows(cols, rel.fetchall())
    spent_sql = time.time() - start
    problem = ""
    if mine_cols != their_cols:
        problem = f"columns {set(mine_cols) ^ set(their_cols)}"
    elif len(mine) != len(theirs):
        problem = f"rows {len(mine)} vs {len(theirs)}"
    else:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        if bad:
            diff = [(c, x, y) for c, x, y in zip(mine_cols, *bad[0]) if x != y]
            problem = f"{len(bad)} rows differ, first: {diff}"
    return problem, len(mine), spent, spent_sql


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(queries())
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = 0
    for name in names:
        try:
            problem, n, spent, spent_sql = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            problem, n, spent, spent_sql = f"{type(error).__name__}: {str(error)[:1500]}", 0, 0.0, 0.0
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name:24} rows={n:7} spark={spent:6.2f}s sql={spent_sql:6.2f}s {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
