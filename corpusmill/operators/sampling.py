"""Seeded samples, the same on every engine and at every parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import seeded_order


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if fewer) with the smallest md5 of seed and key: a top-n, without a full sort."""
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def stratified(df: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each stratum."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(seeded_order(F.col(key), seed), F.col(key)))
    return df.withColumn("_turn", turn).filter(F.col("_turn") <= n).drop("_turn")


def stratified_backfill(df: DataFrame, by: str, per: int, target: int, key: str, seed: int = 42) -> DataFrame:
    """``target`` rows: first up to ``per`` of each stratum, then others, all in seeded order.

    Each stratum is ranked up to its ``per``-th row only; rows behind that one are others.  Keys are distinct.
    """
    order = F.struct(seeded_order(F.col(key), seed).alias("o"), F.col(key).alias("k"))
    ends = stratified(df, by, per, key, seed).groupBy(F.col(by).alias("_by")).agg(F.max(order).alias("_end"))
    picked = df.join(ends, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("_late", F.coalesce(order > F.col("_end"), F.lit(True)))
    return picked.orderBy("_late", seeded_order(F.col(key), seed), key).limit(target).drop("_late", "_by", "_end")


def preferred_groups(df: DataFrame, group: str, least: int, n: int) -> DataFrame:
    """``n`` groups with at least ``least`` rows, or of any size when there is no such group; largest first."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    big = sizes.agg(F.coalesce(F.max("size") >= least, F.lit(False)).alias("_any"))
    chosen = sizes.crossJoin(F.broadcast(big)).filter(~F.col("_any") | (F.col("size") >= least)).drop("_any")
    return chosen.orderBy(F.desc("size"), group).limit(n)
