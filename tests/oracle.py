"""Comparison of a query's rows with those of its SQL in DuckDB, order and column order aside."""

import decimal
import glob
from pathlib import Path

import duckdb


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return tuple(plain(x) for x in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    return value


def rows_of(columns, rows):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def check(spark, sf_dir, query, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    expected = rows_of(columns, [dict(zip(names, r)) for r in answer.fetchall()])
    assert rows_of(columns, df.collect()) == expected
