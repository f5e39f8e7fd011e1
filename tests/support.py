"""Comparison of a query's rows with DuckDB's."""

import glob
import math
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def duck(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def assert_same(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    places = [relation.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in places) for r in relation.fetchall()), key=repr)
    assert ours == theirs
