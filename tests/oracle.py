"""Comparison of a query's Spark rows with its SQL on DuckDB."""

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, list | tuple):
        return tuple(map(value, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(value(r[i]) for i in order) for r in data)


def compare(df, sql, sf_dir):
    """Empty if equal, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names, want = rows([d[0] for d in found.description], found.fetchall())
    own, got = rows(df.columns, df.collect())
    if names != own:
        return f"columns {own} and {names}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"
    return ""
