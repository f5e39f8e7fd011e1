"""Grouped splits without leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import seeded_order


def grouped_split(df: DataFrame, group_col: str, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """``df`` with a column ``split``: whole groups go to train, val or test.

    Distinct groups are ranked by md5 of seed and group; the first ``floor(train * n)`` are train, then half of the
    rest (by the fractions) is val.  Only distinct groups are ranked, never rows: each among those whose md5 begins with
    the same four digits, after the number of groups before these.  So a task sees a 65,536th of the groups, and the
    counts are as many rows at most.  Lazy; a null group is a group.
    """
    if abs(sum(fractions) - 1) > 1e-9:
        raise ValueError("the fractions must add up to 1")
    train, val, test = fractions
    order = seeded_order(F.coalesce(F.col(group_col).cast("string"), F.lit("")), seed)
    groups = df.select(F.col(group_col).alias("_g"), order.alias("_order")).distinct().withColumn("_digits", F.substring("_order", 1, 4))
    counts = groups.groupBy(F.col("_digits").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_d", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    first = F.floor(F.col("_all") * train + 1e-9)
    second = first + F.floor((F.col("_all") - first) * (val / (val + test) if val + test else 0.0) + 1e-9)
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_digits").orderBy("_order", "_g")) - 1
    split = F.when(place < first, F.lit("train")).when(place < second, F.lit("val")).otherwise(F.lit("test"))
    # one row for each four digits
    ranked = groups.join(F.broadcast(counts), F.col("_digits") == F.col("_d")).select("_g", split.alias("split"))
    return df.join(ranked, F.col(group_col).eqNullSafe(F.col("_g"))).drop("_g")


def leakage(df: DataFrame, group_col: str, split_col: str = "split") -> DataFrame:
    """One row (groups, leaking_groups, overlaps): groups in several splits, and pairs of splits that share a group."""
    per_group = df.groupBy(group_col).agg(F.count_distinct(split_col).alias("n"))
    return per_group.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("n") > 1).alias("leaking_groups"),
        F.coalesce(F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)), F.lit(0)).alias("overlaps"),
    )


def require_no_leakage(df: DataFrame, group_col: str, split_col: str = "split") -> DataFrame:
    """``df`` unchanged; raises ValueError when a group is in several splits."""
    if leakage(df, group_col, split_col).first()["leaking_groups"]:
        raise ValueError(f"split leakage: some {group_col} are in more than one split")
    return df


def repair_majority(df: DataFrame, group_col: str, split_col: str = "split") -> DataFrame:
    """Every group takes its most frequent split; ties go to the smallest name, null groups keep their rows' splits."""
    votes = df.filter(F.col(split_col).isNotNull() & F.col(group_col).isNotNull()).groupBy(group_col, split_col).agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy(F.col(group_col).alias("_g")).agg(F.min_by(split_col, F.struct(-F.col("_n"), F.col(split_col))).alias("_s"))
    out = df.join(best, F.col(group_col) == F.col("_g"), "left")
    return out.withColumn(split_col, F.coalesce("_s", split_col)).drop("_g", "_s")


def reuse_or_split(df: DataFrame, group_col: str, split_col: str = "split", min_known: float = 0.95, **options) -> DataFrame:
    """The given splits, repaired by majority, when more than ``min_known`` of the rows have one; else new ones."""
    known = df.agg(F.avg(F.col(split_col).isNotNull().cast("double"))).first()[0]
    if known is not None and known > min_known:
        return repair_majority(df, group_col, split_col)
    return grouped_split(df.drop(split_col), group_col, **options).withColumnRenamed("split", split_col)
