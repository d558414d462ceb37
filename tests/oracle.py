"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def differences(spark, con, sf_dir, name, build, sql) -> str:
    """'' if both give the same rows, else what differs."""
    df = build(spark, sf_dir)
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_cols, want = rows(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return f"{name}: columns {got_cols} and {want_cols}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows and {len(want)}"
    for g, w in zip(got, want, strict=True):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"{name}: {g} and {w}"
    return ""
