"""Compare registered queries with their SQL: rows, column names, value types and values."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def _cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, int):
        return str(value)
    return f"{type(value).__name__}:{value!r}"


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(query, sql, spark, sf_dir) -> str | None:
    """None when both sides agree, otherwise what differs."""
    df = query(spark, sf_dir)
    left = normal(df.columns, [tuple(r) for r in df.collect()])
    right = normal(*sql_rows(sql, sf_dir))
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"first difference: {tuple(x[:80] for x in a)} != {tuple(x[:80] for x in b)}"
    return None
