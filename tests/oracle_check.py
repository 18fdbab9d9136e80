"""Compare every query with its SQL: row count, column names, values."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


def compare(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when equal, else the first difference."""
    frame = query(spark, sf_dir)
    got_columns, got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    want_columns, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows; {got[:2]} | {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None


def main() -> None:
    from conftest import make_session

    import __spark_entry__ as contract

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sf_dir)
    sqls = contract.oracle_sql()
    bad = 0
    for name, query in contract.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sqls:
                diff = compare(spark, con, sf_dir, query, sqls[name])
            else:
                n = len(query(spark, sf_dir).collect())
                diff = None if n else "no rows"
        except Exception as error:  # report and go on
            diff = f"{type(error).__name__}: {str(error)[:600]}"
        bad += diff is not None
        kind = "sql " if name in sqls else "rows"
        print(f"{kind} {time.time() - start:6.2f}s {name:32s} {'ok' if diff is None else diff}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
