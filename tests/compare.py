"""Compare a query with its SQL: columns by name, rows as multisets."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    relation = con.execute(sql)
    columns = [d[0] for d in relation.description]
    types = {d[0]: str(d[1]) for d in relation.description}
    expected_raw = relation.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    names = {
        "string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
        "int": "INTEGER",
    }
    for name, dtype in df.dtypes:
        if names.get(dtype, dtype) != types[name]:
            return f"type of {name}: {dtype} != {types[name]}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    expected = rows_of(columns, expected_raw)
    if len(got) != len(expected):
        return f"row count {len(got)} != {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return f"first difference\n  spark {a}\n  sql   {b}"
    return None
