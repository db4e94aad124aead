"""Compare registered queries with their SQL in DuckDB: columns, row count and every value.

    python tests/oracle_check.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """One spelling per value: numbers without a type, missing values as None."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(df, con, sql):
    """None if equal, else a short description."""
    relation = con.execute(sql)
    names = [column[0] for column in relation.description]
    expected = rows_of(names, relation.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    actual = rows_of(df.columns, [tuple(row) for row in df.collect()])
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    for got, want in zip(actual, expected):
        if got != want:
            return f"first difference: {got} != {want}"
    return None


def main() -> int:
    from tests.conftest import make_session

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = make_session()
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if parts and not any(part in name for part in parts):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            problem = compare(df, con, oracle[name]) if name in oracle else f"no SQL, {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None and name in oracle
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
