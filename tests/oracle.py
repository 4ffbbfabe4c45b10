"""Holds a query's rows against its SQL in DuckDB."""

import math
from datetime import datetime
from pathlib import Path

import duckdb

FOLDER = Path("/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, str, bytes)) else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(map(plain, r)) for r in zip(*(table[n].to_pylist() for n in names))), key=repr)


def same(spark, con, query, sql):
    got, want = rows(query(spark, str(FOLDER)).toArrow()), rows(con.sql(sql).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]
