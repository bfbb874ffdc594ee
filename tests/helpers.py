"""Comparison of Spark rows with DuckDB rows, and the test tables."""

from __future__ import annotations

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    return con


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(row[k]) if isinstance(row[k], float) else str(row[k]) for k in order) for row in rows)


def same_rows(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, found.fetchall())
