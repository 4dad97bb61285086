"""Runs a query's DuckDB twin on the same files and compares rows without regard to order."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def run_sql(sql: str, sf: str = SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return repr(v)
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else f"{round(float(v), 5) + 0.0:.5f}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, sf: str = SF):
    names, rows = run_sql(sql, sf)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rows)
