"""Compare a Spark result with its check SQL in DuckDB: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def plain(value):
    """A value in a form that both engines share; types that differ stay different."""
    if isinstance(value, Decimal):
        return ("decimal", value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, dt.datetime) or isinstance(value, dt.date):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """What differs between the Spark result and the SQL result; empty when they agree."""
    found = con.execute(sql)
    sql_columns = [d[0] for d in found.description]
    expected = rows_of(sql_columns, found.fetchall())
    actual = rows_of(df.columns, df.collect())
    problems = []
    types = {f.name: SQL_TYPES.get(f.dataType.simpleString()) for f in df.schema.fields}
    sql_types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    if types != sql_types:
        problems.append(f"types {types} against {sql_types}")
    if sorted(sql_columns) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} against {sorted(sql_columns)}")
    if sum(expected.values()) != sum(actual.values()):
        problems.append(f"{sum(actual.values())} rows against {sum(expected.values())}")
    if expected != actual:
        problems.append(f"only Spark: {list((actual - expected).items())[:3]}; only SQL: {list((expected - actual).items())[:3]}")
    return problems
