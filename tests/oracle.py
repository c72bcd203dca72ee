"""Compare a query with its SQL in DuckDB, value by value."""

from __future__ import annotations

import datetime
import math

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return datetime.datetime(value.year, value.month, value.day)
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    rows = [tuple(map(_cell, row)) for row in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False,) for v in r))


def kinds(names_types: list[tuple[str, str]]) -> list[tuple[str, str]]:
    same = {"bigint": "int64", "int": "int32", "integer": "int32", "varchar": "string", "date": "date"}
    return sorted((n, same.get(t.lower(), t.lower())) for n, t in names_types)


def differences(spark_df, con, sql: str) -> list[str]:
    cursor = con.execute(sql)
    expected_kinds = kinds([(d[0], str(d[1])) for d in cursor.description])
    expected = cursor.df()
    got_kinds = kinds(spark_df.dtypes)
    rows = spark_df.collect()
    got = pd.DataFrame([tuple(r) for r in rows], columns=spark_df.columns, dtype=object)
    found = []
    if got_kinds != expected_kinds:
        odd = set(got_kinds) ^ set(expected_kinds)
        found.append(f"columns differ: {sorted(odd)}")
        if sorted(got.columns) != sorted(expected.columns):
            return found
    a, b = canonical(got), canonical(expected)
    if len(a) != len(b):
        found.append(f"{len(a)} rows instead of {len(b)}")
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {wrong[0]}")
    return found
