"""Runs queries in Spark and their SQL twins in DuckDB and compares the rows.

    python tools/check_oracle.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """One form for a value of either engine; no tolerance beyond float noise."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(found, key=repr)


def compare(con, df, sql):
    """None when equal, else a short text about the first difference."""
    cursor = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    got_cols, got = rows_of(df.columns, df.collect())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"row count {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"spark {g}\n  sql   {w}"
        for a, b in zip(g, w):
            if type(a) is not type(b):
                return f"types {type(a)} {type(b)} for {a!r}"
    return None


def main() -> int:
    from watchloom.plans import ORACLES, QUERIES
    from watchloom.session import build_session

    sf_dir, keys = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                "spark.ui.showConsoleProgress": "false"}
    )
    con = duck(sf_dir)
    bad = 0
    for key in keys:
        start = time.time()
        try:
            df = QUERIES[key](spark, sf_dir)
            if key in ORACLES:
                problem = compare(con, df, ORACLES[key])
                n = "ok"
            else:
                n, problem = f"rows only ({df.count()})", None
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, n = f"{type(error).__name__}: {str(error)[:900]}", ""
        if problem:
            bad += 1
        print(f"{'FAIL' if problem else 'pass'} {key} {time.time() - start:.1f}s {problem or n}", flush=True)
    print(f"{len(keys) - bad}/{len(keys)} good")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
