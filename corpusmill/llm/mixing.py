"""Mixing sources to target token weights by entropy balancing.

Among all document rates between 0 and a cap, the ones closest in relative
entropy to taking every document once, subject to each source's token target,
are exponential tilts ``min(cap, exp(tilt * size))`` with one tilt per source.
The tilts solve the convex dual, by Newton iterations whose sums run over the
whole table, pre-aggregated to (source, size) counts.  The rates are then
rounded to copies: within a count cell by hash order, across a source's cells
by cumulative rounding, so a source misses its target by at most about half of
its largest document; two single copies more or less then bring it nearer.

Edge cases: null and empty texts have size 0, take no words and stay once; a null source
is a source of its own and comes last; sources without words have target 0;
repeated rows are documents of their own; columns other than those named are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.plans.scratch import materialize, remove

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
ROWS_PER_SALT = 1_024
TOLERANCE = 1e-9
MAX_ROUNDS = 80
FINE_ROUNDS = 2


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from a table of (source, source_size), one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn and divide ``share`` of all words; where a target is
    above ``cap`` times the source's size it stops there, and the excess goes to the others by weight.  That is a
    common level: ``target = min(cap * source_size, level * weight)``; the level follows from one pass over the
    sources in the order in which they reach their caps.
    """
    n = len(weights)
    everyone = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % n + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(cap))
    in_order = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sizes.select("source", "source_size", weight.alias("weight"), limit.alias("limit"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everyone) * F.lit(float(share)))
        .withColumn("all_weights", F.sum("weight").over(everyone))
        .withColumn("level", level)
        .withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(in_order))
        .select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))
    )


def _rate(tilt: Column, size: Column, cap: float) -> Column:
    return F.when(tilt * size >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(tilt * size))


def solve_tilts(cells: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, tilt): the dual solution for each source with words and a target below its cap.

    ``cells`` has (source, size, n).  Each round is one distributed pass that sums the words taken at the present
    tilts and their derivatives; a Newton step that leaves the bracket known so far is replaced by its middle.
    """
    log_cap = math.log(cap)
    cells = cells.filter("size > 0")
    state = (
        cells.groupBy("source")
        .agg(F.min("size").alias("least"), F.sum(F.col("n") * F.col("size")).alias("words"))
        .join(targets.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")))
        .filter(F.col("target") < F.col("words") * cap * (1 - TOLERANCE))
        .select(
            "source",
            "target",
            F.when(F.col("target") > 0, F.least(F.lit(0.0), F.log(F.col("target") / F.col("words")) / F.col("least"))).otherwise(F.lit(float("-inf"))).alias("low"),
            (F.lit(log_cap) / F.col("least")).alias("high"),
            F.when(F.col("target") > 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))).alias("tilt"),
            (F.col("target") <= 0).alias("done"),
        )
    )
    state = materialize(state, "tilts")
    for _ in range(MAX_ROUNDS):
        if state.filter("not done").isEmpty():
            break
        taken = _rate(F.col("tilt"), F.col("size"), cap) * F.col("size") * F.col("n")
        slope = F.when(F.col("tilt") * F.col("size") < log_cap, taken * F.col("size")).otherwise(F.lit(0.0))
        sums = (
            cells.withColumnRenamed("source", "of")
            .join(state.filter("not done").select("source", "tilt"), F.col("of").eqNullSafe(F.col("source")))
            .groupBy("source")
            .agg(F.sum(taken).alias("taken"), F.sum(slope).alias("slope"))
            .withColumnRenamed("source", "of")
        )
        miss = F.col("taken") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("tilt") - miss / F.col("slope"))
        over = F.when((F.col("step") > F.col("low")) & (F.col("step") < F.col("high")), F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        hit = F.abs(miss) <= TOLERANCE * F.col("target")
        after = (
            state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
            .withColumns({"step": step, "low": low, "high": high, "done": F.col("done") | F.coalesce(hit, F.lit(False))})
            .withColumn("tilt", F.when(F.col("done"), F.col("tilt")).otherwise(over))
            .select("source", "target", "low", "high", "tilt", "done")
        )
        # a bracket without a number between its ends is as exact as it gets
        after = materialize(after.withColumn("done", F.col("done") | (F.col("tilt") <= F.col("low")) | (F.col("tilt") >= F.col("high"))), "tilts")
        remove(state)
        state = after
    return state.select("source", "tilt")


def _nearer(plan: DataFrame, cap: int) -> DataFrame:
    """``plan`` with one copy more or less in the cell of each source whose size is closest to what the source misses."""
    miss = plan.groupBy("source").agg((F.first("target") - F.sum(F.col("all_copies") * F.col("size"))).alias("miss")).withColumnRenamed("source", "its")
    plan = plan.join(miss, F.col("source").eqNullSafe(F.col("its")))
    free = F.when(F.col("miss") > 0, F.col("all_copies") < F.col("n") * cap).otherwise(F.col("all_copies") > 0)
    rest = F.abs(F.abs(F.col("miss")) - F.col("size"))
    chosen = plan.filter(free & (rest < F.abs(F.col("miss")))).groupBy("source").agg(F.min_by("size", F.struct(rest, "size")).alias("chosen")).withColumnRenamed("source", "theirs")
    change = F.when(F.col("size") == F.col("chosen"), F.signum("miss").cast("long")).otherwise(F.lit(0))
    return plan.join(chosen, F.col("source").eqNullSafe(F.col("theirs")), "left").select(
        "source", "size", "n", "source_size", "target", "rate", (F.col("all_copies") + F.coalesce(change, F.lit(0))).alias("all_copies")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken, row_hash), one row for every row of ``docs``.

    ``size`` counts words, ``copies`` is how often the mix takes the document, ``taken`` its words with repeats.
    The texts are read once and never shuffled.  Hashes depend on the rows alone, so reruns agree.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(id_col, text_col, source_col).alias("row_hash"),
    )
    rows = materialize(rows, "sizes")
    cells = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    targets = materialize(source_targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap), "targets")
    tilts = solve_tilts(cells, targets, cap)

    # sums of floating-point numbers depend on the tasks' order in their last digits; rounded rates do not
    rate = F.coalesce(_rate(F.col("tilt"), F.col("size"), cap), F.lit(float(cap)))
    up_to = Window.partitionBy("source").orderBy("size")
    plan = (
        cells.join(targets.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")))
        .join(tilts.withColumnRenamed("source", "tilted"), F.col("source").eqNullSafe(F.col("tilted")), "left")
        .withColumn("rate", F.round(F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("target") > 0, rate).otherwise(F.lit(0.0)), 9))
        .withColumn("rounded", F.floor(F.sum(F.col("n") * F.col("rate")).over(up_to) + 0.5))
        .withColumn("all_copies", F.col("rounded") - F.coalesce(F.lag("rounded").over(up_to), F.lit(0)))
        .withColumn("all_copies", F.least("all_copies", F.col("n") * cap))
        .select("source", "size", "n", "source_size", "target", "rate", "all_copies")
    )
    for _ in range(FINE_ROUNDS):
        plan = _nearer(materialize(plan, "plan"), cap)
    base = F.floor(F.col("all_copies") / F.col("n"))
    plan = plan.select(
        F.col("source").alias("of"), F.col("size").alias("sized"), "source_size", "target", "rate", base.alias("base"),
        (F.col("all_copies") - base * F.col("n")).alias("quota"), F.ceil(F.col("n") / ROWS_PER_SALT).alias("salts"),
    )
    plan = materialize(plan, "plan")

    # within a cell the first rows by hash get one copy more; large cells are ranked in salted parts, with offsets
    keyed = rows.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("sized"))).withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "doc_id", "row_hash"), F.col("salts")))
    placed = keyed.withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("row_hash", "doc_id")))
    parts = keyed.groupBy(F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("t")).agg(F.count(F.lit(1)).alias("m"))
    so_far = Window.partitionBy("s", "z").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("m").over(so_far), F.lit(0))).drop("m")
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("t")))
    copies = (F.col("base") + F.when(F.col("place") + F.col("offset") <= F.col("quota"), F.lit(1)).otherwise(F.lit(0))).cast("long")
    return placed.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "row_hash"
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Rows that agree in id, text and source are told apart by a number, so each gets the copies of one.  The texts
    are shuffled once, to meet the decisions.
    """
    by_hash = Window.partitionBy("mix_hash")
    taken = mix(docs, id_col, text_col, source_col, **options).select(F.col("row_hash").alias("mix_hash"), F.col("copies").alias("mix_copies"))
    taken = taken.withColumn("mix_number", F.row_number().over(by_hash.orderBy(F.desc("mix_copies"))))
    # the row travels as one column, so its names clash with nothing
    rows = docs.select(F.xxhash64(id_col, text_col, source_col).alias("mix_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    numbered = rows.withColumn("mix_number", F.row_number().over(by_hash.orderBy(F.col("row").getField(id_col))))
    met = numbered.join(taken.filter("mix_copies > 0"), ["mix_hash", "mix_number"])
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("row.*")
