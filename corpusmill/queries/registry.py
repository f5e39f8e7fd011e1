"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Shared pieces of SQL: white space of every script at the ends; the share of characters outside ASCII.
STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
NON_ASCII = r"CASE WHEN coalesce({0}, '') = '' THEN 1.0 ELSE (length({0}) - length(regexp_replace({0}, '[^\x00-\x7F]', '', 'g'))) / length({0}) END"


def query(sql: str | None = None):
    """Register a function under its own name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
