"""Guarded joins and set operations on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.scratch import materialize


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` unchanged; raises ValueError when a column is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def join_one_to_one(a: DataFrame, b: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """The join of two tables in which no key repeats; raises ValueError otherwise."""
    for side, df in (("left", a), ("right", b)):
        if not repeated_keys(df, on).isEmpty():
            raise ValueError(f"keys {on} repeat on the {side} side")
    return a.join(b, on, how)


def dynamic_key_join(a: DataFrame, b: DataFrame, candidates: tuple[str, ...] = ("filename_stem", "pmcid"), suffix: str = "_work") -> DataFrame:
    """Inner join on the first candidate key that both tables have; other shared names of ``b`` get the suffix."""
    key = next((k for k in candidates if k in a.columns and k in b.columns), None)
    if key is None:
        raise ValueError(f"no common key among {candidates}")
    renamed = b.select(*(F.col(c).alias(c if c == key or c not in a.columns else c + suffix) for c in b.columns))
    return a.join(renamed, key)


def pending(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys are not done yet."""
    return df.join(done.select(*on).distinct(), on, "left_anti")


def both_way_missing(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """(key, side): keys of one table that the other lacks, each once; a null key is lacking on both sides.

    Both tables' keys are grouped in one pass, repeats before the shuffle; no side is sorted, and none is held for the other.
    """
    seen = a.select(on, F.lit(True).alias("_left")).union(b.select(on, F.lit(False)))
    sides = seen.groupBy(on).agg(F.bool_or("_left").alias("_l"), F.bool_or(~F.col("_left")).alias("_r"))
    lone = [F.when(F.col(x) & (~F.col(y) | F.col(on).isNull()), F.lit(side)) for x, y, side in (("_l", "_r", "only_left"), ("_r", "_l", "only_right"))]
    return sides.select(on, F.explode(F.array_compact(F.array(*lone))).alias("side"))


def probe_join(stems: DataFrame, files: DataFrame, stem: str = "stem", extensions: tuple[str, ...] = (".png", ".jpg", ".jpeg", ".gif")) -> DataFrame:
    """``stems`` with ``path``: of the files with that stem the one whose extension comes first in the list."""
    ranked = files.withColumn("_rank", F.array_position(F.array(*(F.lit(e) for e in extensions)), F.lower(F.col("extension")))).filter("_rank > 0")
    first = ranked.groupBy(stem).agg(F.min_by("path", F.struct("_rank", "path")).alias("path"))
    return stems.join(first, stem, "left")


def ranked_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_place``, the rank from 0 in the given order.

    The numbers come from a range sort and per-partition counts, so no single task sees all rows.
    """
    ordered = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_turn", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ordered")  # a second evaluation could cut the ranges elsewhere
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_turn").alias("_least"))
    # one row for each partition
    before = counts.select(
        F.col("_part").alias("_p"), "_least", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    out = ordered.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    # the turns of a partition are consecutive
    return out.withColumn("_place", F.col("_before") + F.col("_turn") - F.col("_least")).drop("_part", "_turn", "_least", "_p", "_before")


def surrogate_ids(df: DataFrame, prefix: str, order: list[str], name: str = "figure_id") -> DataFrame:
    """``df`` with ``prefix__N``, N counting from 0 in the given order."""
    return ranked_rows(df, order).withColumn(name, F.concat_ws("__", F.col(prefix), F.col("_place").cast("string"))).drop("_place")


def side_by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The rows of two tables side by side: the n-th of one beside the n-th of the other, null where one is shorter.

    Position is rank in a stated order, as tables have none of their own.  Names must differ.
    """
    both = set(left.columns) & set(right.columns)
    if both:
        raise ValueError(f"columns of both tables: {sorted(both)}")
    a, b = ranked_rows(left, left_order), ranked_rows(right, right_order).withColumnRenamed("_place", "_other")
    return a.join(b, F.col("_place") == F.col("_other"), "full").drop("_place", "_other")


def split_records(records: DataFrame, splits: DataFrame, keys: list[str], split: str = "split") -> tuple[DataFrame, DataFrame]:
    """(records with the split of their keys, keys of records that no split lists).  Nothing falls back to a default; null keys match nothing."""
    listed = splits.select(*keys, split).distinct()
    return records.join(listed, keys), records.join(listed, keys, "left_anti").select(*keys).distinct()


def tracks_side_by_side(left: DataFrame, right: DataFrame, key: str, values: list[str], names: tuple[str, str], fallback: str = "no match") -> DataFrame:
    """(key, value_left, value_right, ...) of two tracks, one row for each key of either; missing texts show the fallback."""
    a = left.select(F.col(key).alias("_a"), *(F.col(v).alias(f"{v}_{names[0]}") for v in values))
    b = right.select(F.col(key).alias("_b"), *(F.col(v).alias(f"{v}_{names[1]}") for v in values))
    met = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full")
    kinds = dict(met.dtypes)
    shown = [F.coalesce(F.col(c), F.lit(fallback)).alias(c) if kinds[c] == "string" else F.col(c) for v in values for c in (f"{v}_{names[0]}", f"{v}_{names[1]}")]
    return met.select(F.coalesce("_a", "_b").alias(key), *shown)
