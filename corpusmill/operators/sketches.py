"""Sketches that are kept for each part of a table and merged over parts and runs.

A row of sketches holds, for each column, the number of values, the extremes, a KLL sketch of the quantiles, a
HyperLogLog sketch of the distinct values and a frequent-item sketch, as asked for.  Such rows are small whatever the
part's size; a new day is sketched alone and merged with the days before, none of which is read again.

Nulls (and NaN) are no values.  A part without values has no sketch, and merging passes over it.  An empty table has no
rows of sketches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.readers import path_exists

KLL_K = 4096
HLL_LG = 14
TRACKED = 10_000  # frequent items that a sketch tracks


def rank_error(k: int = KLL_K) -> float:
    """The distance of a quantile's rank from the one asked for, as a share of the values, at a confidence of 99 in 100."""
    return 2.296 / k**0.9021


def distinct_error(lg: int = HLL_LG) -> float:
    """Three standard errors of a distinct count, as a share of it."""
    return 3 * 1.04 / math.sqrt(2**lg)


def frequent_error(tracked: int = TRACKED) -> float:
    """What the count of a frequent item may be off, as a share of the values."""
    return 3.5 / 2 ** math.floor(math.log2(tracked / 0.75))


def _number(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _hashable(df: DataFrame, column: str) -> Column:
    """The column in a type that the distinct sketch takes; equal values stay equal, other than 0.0 and -0.0 no two fall together."""
    kind = dict(df.dtypes)[column]
    if kind in ("int", "bigint", "string", "binary"):
        return F.col(column)
    return (_number(column) + 0.0).cast("string") if kind in ("float", "double") else F.col(column).cast("string")


def sketch_parts(df: DataFrame, by: list[str], quantiles: list[str] = (), distinct: list[str] = (), frequent: list[str] = ()) -> DataFrame:
    """One row of sketches for each part of ``df``, the rows with equal ``by``: one pass with partial aggregation.

    ``quantiles`` gives n, low, high and kll of a column; ``distinct`` hll; ``frequent`` items, each as
    ``<column>_<name>``.
    """
    made = [F.count(F.lit(1)).alias("rows")]
    for c in quantiles:
        made += [F.count(_number(c)).alias(f"{c}_n"), F.min(_number(c)).alias(f"{c}_low"), F.max(_number(c)).alias(f"{c}_high")]
        made.append(F.kll_sketch_agg_double(_number(c), KLL_K).alias(f"{c}_kll"))
    made += [F.hll_sketch_agg(_hashable(df, c), HLL_LG).alias(f"{c}_hll") for c in distinct]
    made += [F.expr(f"approx_top_k_accumulate(`{c}`, {TRACKED})").alias(f"{c}_items") for c in frequent]
    return df.groupBy(*by).agg(*made)


def merge_parts(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Rows of sketches merged to the coarser ``by``, as if the rows below them had been sketched together."""
    made = []
    for name in sketches.columns:
        kind = name.rsplit("_", 1)[-1]
        if name in by:
            continue
        if kind == "kll":
            held = F.when(F.col(f"{name[:-4]}_n") > 0, F.col(name))
            made.append(F.kll_merge_agg_double(held, KLL_K).alias(name))
        elif kind == "hll":
            made.append(F.hll_union_agg(name).alias(name))
        elif kind == "items":
            made.append(F.expr(f"approx_top_k_combine(`{name}`, {TRACKED})").alias(name))
        elif kind in ("n", "rows"):
            made.append(F.sum(name).alias(name))
        elif kind in ("low", "high"):
            made.append((F.min if kind == "low" else F.max)(name).alias(name))
    return sketches.groupBy(*by).agg(*made)


def quantile(column: str, share: float) -> Column:
    """The value of ``column`` at a share of its ranks, from a row of sketches; null without values."""
    return F.when(F.col(f"{column}_n") > 0, F.kll_sketch_get_quantile_double(f"{column}_kll", F.lit(float(share))))


def distinct_count(column: str) -> Column:
    """The number of different values of ``column``, from a row of sketches."""
    return F.hll_sketch_estimate(f"{column}_hll")


def frequent_items(sketches: DataFrame, by: list[str], column: str, most: int) -> DataFrame:
    """(by, item, count): at most ``most`` frequent values of each row of sketches; counts are off by :func:`frequent_error` at most."""
    found = sketches.select(*by, F.explode(F.expr(f"approx_top_k_estimate(`{column}_items`, {most})")).alias("x"))
    return found.select(*by, "x.item", "x.count")


def heavy_hitters(df: DataFrame, column: str, share: float, by: list[str] = ()) -> DataFrame:
    """(by, item, count), exact: values of ``column`` with at least ``share`` of the rows, nulls left out of both.

    Candidates come from the sketches of the parts ``by``, which miss none above their error; their rows alone are then
    counted.  ``share`` must exceed the error.  Keys that are rare never leave the sketches, so neither a shuffle of all
    keys nor a hot one is met.
    """
    if share <= frequent_error():
        raise ValueError(f"a share of {share} is within the sketches' error of {frequent_error():.6f}")
    merged = merge_parts(sketch_parts(df.filter(F.col(column).isNotNull()), list(by), frequent=[column]), [])
    totals = merged.select(F.col("rows").alias("all_rows"), F.explode(F.expr(f"approx_top_k_estimate(`{column}_items`, {math.ceil(1 / (share - frequent_error()))})")).alias("x"))
    candidates = totals.filter(F.col("x.count") >= (share - frequent_error()) * F.col("all_rows")).select(F.col("x.item").alias(column), "all_rows")
    # at most 1 / (share - error) rows
    counted = df.join(F.broadcast(candidates), column).groupBy(column, "all_rows").agg(F.count(F.lit(1)).alias("count"))
    return counted.filter(F.col("count") >= share * F.col("all_rows")).select(F.col(column).alias("item"), "count")


def add_run(sketches: DataFrame, root: str, run: str) -> None:
    """Keep the sketches of one run at ``root``; a repeated run replaces its own and no other."""
    sketches.write.mode("overwrite").parquet(f"{root}/run={run}")


def kept_runs(spark: SparkSession, root: str) -> DataFrame:
    """All rows of sketches at ``root``, with their ``run``; raises FileNotFoundError when there is none."""
    if not path_exists(spark, f"{root}/run=*/_SUCCESS"):
        raise FileNotFoundError(root)
    return spark.read.parquet(root)
