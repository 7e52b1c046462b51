"""Holds a query's rows against DuckDB's over the same files."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return con


def plain(row) -> tuple:
    return tuple(round(x, 6) if isinstance(x, float) and not math.isnan(x) else x for x in row)


def same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    assert sorted(con.sql(sql).columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = sorted((plain(r) for r in con.sql(f"SELECT {quoted} FROM ({sql})").fetchall()), key=str)
    got = sorted((plain(r) for r in df.select(*[df[c] for c in columns]).collect()), key=str)
    assert got == want
