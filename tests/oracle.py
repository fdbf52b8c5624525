"""Rows of a query and of its SQL in DuckDB, in one comparable form."""

from __future__ import annotations

from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(x: object) -> str:
    if isinstance(x, bool) or x is None:
        return str(x)
    return f"{x:.6f}" if isinstance(x, float) else str(x)


def rows(names: list[str], found: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def of_spark(df) -> tuple[list[str], list]:
    return sorted(df.columns), rows(df.columns, df.collect())


def of_duckdb(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows(names, got.fetchall())
