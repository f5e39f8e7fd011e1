"""Exact and near duplicate groups, canonical rows."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import non_ascii_ratio, strip
from corpusmill.functions.vectors import hamming
from corpusmill.operators.graph import components


def exact_groups(df: DataFrame, hash_col: str, member: str, order: str | None = None, top: int = 5) -> DataFrame:
    """(hash, size, members): groups of more than one row with equal hashes, the first ``top`` members in order; null hashes form none.

    The other members are counted, not gathered, so a group of any size is a small row; joining on the hash gives all.
    """
    order = order or member
    keyed = df.filter(F.col(hash_col).isNotNull()).select(hash_col, F.col(order).alias("_o"), F.col(member).alias("_m"))
    sizes = keyed.groupBy(hash_col).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    turn = F.row_number().over(Window.partitionBy(hash_col).orderBy("_o", "_m"))
    first = keyed.withColumn("_turn", turn).filter(F.col("_turn") <= top)  # a group limit: tasks cut their part before the shuffle
    members = F.transform(F.array_sort(F.collect_list(F.struct("_turn", "_m"))), lambda p: p["_m"]).alias("members")
    return sizes.join(first.groupBy(hash_col).agg(members), hash_col)


def group_sizes(df: DataFrame, hash_col: str, key: str) -> DataFrame:
    """(size, groups, same_key, cross_key): how many groups there are of each size, within one key and across keys."""
    groups = df.filter(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.count(F.lit(1)).alias("size"), F.count_distinct(key).alias("keys")).filter("size > 1")
    return groups.groupBy("size").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("keys") == 1).alias("same_key"), F.count_if(F.col("keys") > 1).alias("cross_key"))


def canonical_order(text: Column, *ties: Column) -> list[Column]:
    """The order in which the first row of a group is its canonical one: with text, plain script, long, then the ties."""
    full = F.coalesce(strip(text) != "", F.lit(False))
    return [full.desc(), non_ascii_ratio(text).asc(), F.coalesce(F.length(text), F.lit(0)).desc(), *(t.asc() for t in ties)]


def canonical(df: DataFrame, hash_col: str, text_col: str, *ties: str) -> DataFrame:
    """One row for each hash by :func:`canonical_order`; rows with a null hash all stay.

    The chosen row is a minimum over the group, found with partial aggregation before the shuffle.
    """
    columns = df.columns
    full = F.coalesce(strip(F.col(text_col)) != "", F.lit(False))
    key = F.struct(~full, non_ascii_ratio(F.col(text_col)), -F.coalesce(F.length(text_col), F.lit(0)), *(F.col(t) for t in ties))
    best = df.filter(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min_by(F.struct(*columns), key).alias("row"))
    return best.select(*(F.col(f"row.{c}") for c in columns)).unionByName(df.filter(F.col(hash_col).isNull()))


# Masks that one band may probe with; they are literals of the plan.
PROBES = 1024


def band_plan(max_distance: int, bits: int, rows: int) -> tuple[int, int]:
    """(bands, radius) of the least expected work: rows that probe, and candidates that share one of 2 ** width codes by chance.

    Of ``bands`` bands one differs in at most ``max_distance // bands`` bits, so every choice finds all pairs.
    """
    plans = []
    for bands in range(1, max_distance + 2):
        width, radius = bits // bands, max_distance // bands
        probes = sum(math.comb(width + (bits % bands > 0), k) for k in range(radius + 1))
        if probes <= PROBES:
            plans.append((bands * probes * (1 + rows / 2**width), bands, radius))
    return min(plans)[1:]


def near_pairs(df: DataFrame, id_col: str, hash_col: str, max_distance: int = 4, bits: int = 64, rows: int | None = None) -> DataFrame:
    """(a, b, distance) of all pairs a < b whose hashes differ in at most ``max_distance`` bits.

    Lossless banding: in such a pair one band of the bits differs in at most the radius of :func:`band_plan`.  One side
    probes with all codes of its bands within the radius, so candidates meet in an equi-join; each pair comes from its
    first such band only, so no pair is made twice.  ``rows`` sets the plan's cost and is counted when it is not given;
    the result does not depend on it.
    """
    if max_distance >= bits:
        raise ValueError("more bands than bits")
    base = df.select(F.col(id_col).alias("id"), F.col(hash_col).cast("long").alias("h")).filter("h is not null")
    bands, radius = band_plan(max_distance, bits, base.count() if rows is None else rows)
    edges = [i * bits // bands for i in range(bands + 1)]
    cuts = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]

    def band(h: Column, i: int) -> Column:
        return F.shiftrightunsigned(h, cuts[i][0]).bitwiseAND(F.lit((1 << cuts[i][1]) - 1 if cuts[i][1] < 63 else -1))

    def near_codes(h: Column, i: int) -> Column:
        masks = [sum(1 << bit for bit in flipped) for k in range(radius + 1) for flipped in itertools.combinations(range(cuts[i][1]), k)]
        return F.transform(F.lit(masks).cast("array<long>"), lambda mask: band(h, i).bitwiseXOR(mask))

    def spread(codes) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), codes(F.col("h"), i).alias("codes")) for i in range(bands))))
        return base.select("id", "h", each.alias("k")).select("id", "h", "k.band", F.explode("k.codes").alias("code"))

    a, b = spread(near_codes).alias("a"), spread(lambda h, i: F.array(band(h, i))).alias("b")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.code") == F.col("b.code")) & (F.col("a.id") < F.col("b.id")))
    earlier = F.lit(False)
    for i in range(bands):
        earlier = earlier | ((F.col("a.band") > i) & (hamming(band(F.col("a.h"), i), band(F.col("b.h"), i)) <= radius))
    distance = hamming(F.col("a.h"), F.col("b.h"))
    return met.filter(~earlier & (distance <= max_distance)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), distance.alias("distance"))


def near_groups(pairs: DataFrame) -> DataFrame:
    """(id, group_id) of all rows in a pair: groups are closed transitively, named by their smallest member."""
    return components(pairs).select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def duplicate_flags(df: DataFrame, id_col: str, hash_col: str, near: DataFrame) -> DataFrame:
    """(id, duplicate_flag): 'exact_duplicate' or 'near_duplicate' for all but the first row of a group; exact wins.

    ``near`` has (id, group_id).
    """
    keyed = df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("hash")).join(near, "id", "left")
    firsts = keyed.filter("hash is not null").groupBy(F.col("hash").alias("its_hash")).agg(F.min("id").alias("first_exact"))
    exact = F.when(F.col("id") != F.col("first_exact"), F.lit("exact_duplicate"))
    close = F.when(F.col("group_id") != F.col("id"), F.lit("near_duplicate"))
    return keyed.join(firsts, F.col("hash") == F.col("its_hash"), "left").select("id", F.coalesce(exact, close).alias("duplicate_flag"))


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``base`` with the same keys (null keys match each other)."""
    both = base.withColumn("_round", F.lit(0)).unionByName(new.withColumn("_round", F.lit(1)))
    columns = base.columns
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_round").alias("row"))
    return last.select(*(F.col(f"row.{c}") for c in columns))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")
