"""Boxes that overlap, by a grid; and one-to-one matching of what overlaps, in rounds.

A box goes to every cell of the grid that it covers, and boxes meet by cell, so the work follows the boxes near each
other and not all pairs of a sheet.  Two boxes may share several cells: the pair counts in the first of them only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.scratch import materialize, remove

SIDES = ("x1", "y1", "x2", "y2")


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def gridded(boxes: DataFrame, size: float) -> DataFrame:
    """``boxes`` once for each cell (gx, gy) of side ``size`` that they cover; boxes with a missing or inverted side are left out."""
    right = boxes.filter("x1 <= x2 and y1 <= y2")
    for name, low, high in (("gx", "x1", "x2"), ("gy", "y1", "y2")):
        right = right.withColumn(name, F.explode(F.sequence(_cell(F.col(low), size), _cell(F.col(high), size))))
    return right


def overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The area that two boxes share; 0 where they only touch or do not meet."""
    width = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    height = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def overlapping(a: DataFrame, b: DataFrame, sheet: str, size: float, least_iou: float = 0.0) -> DataFrame:
    """(sheet, a, b, iou) of the boxes of two tables (sheet, id, x1, y1, x2, y2) that share an area on one sheet, with an IoU of ``least_iou`` or more.

    ``size`` is the side of a cell, best about that of a usual box.  Much larger boxes are in many cells, much smaller
    ones meet others that they do not overlap; the pairs are the same.
    """
    names = {"a": {c: F.col(f"a_{c}") for c in SIDES}, "b": {c: F.col(f"b_{c}") for c in SIDES}}
    sides = {
        t: gridded(df, size).select(F.col(sheet).alias("_sheet"), "gx", "gy", F.col("id").alias(t), *(F.col(c).cast("double").alias(f"{t}_{c}") for c in SIDES)) for t, df in (("a", a), ("b", b))
    }
    met = sides["a"].join(sides["b"], ["_sheet", "gx", "gy"])
    first = (F.col("gx") == F.greatest(*(_cell(names[t]["x1"], size) for t in "ab"))) & (F.col("gy") == F.greatest(*(_cell(names[t]["y1"], size) for t in "ab")))
    area = {t: (n["x2"] - n["x1"]) * (n["y2"] - n["y1"]) for t, n in names.items()}
    shared = overlap_area(names["a"], names["b"])
    iou = F.round(shared / (area["a"] + area["b"] - shared), 9)
    return met.filter(first & (shared > 0)).withColumn("iou", iou).filter(F.col("iou") >= least_iou).select(F.col("_sheet").alias(sheet), "a", "b", "iou")


def greedy_matches(pairs: DataFrame, sheet: str, max_rounds: int = 1_000) -> DataFrame:
    """(sheet, a, b, iou): the pairs that a walk from the greatest IoU down keeps when each box may be kept once; ties go by a, then b.

    A pair that is the first of both its boxes is kept whatever the others do, so every round keeps all such pairs at
    once and drops the pairs of their boxes.  At least the first pair left of a sheet is kept in each round; no sheet is
    gathered in one task's memory.
    """
    left, kept = materialize(pairs.select(F.col(sheet).alias("_sheet"), "a", "b", "iou"), "pairs"), []
    order = F.struct(-F.col("iou"), "a", "b")
    while not left.isEmpty():
        if len(kept) == max_rounds:
            raise RuntimeError(f"pairs are left after {max_rounds} rounds")
        by_a, by_b = (left.groupBy("_sheet", t).agg(F.min_by(F.struct("a", "b"), order).alias(f"of_{t}")) for t in "ab")
        ranked = left.join(by_a, ["_sheet", "a"]).join(by_b, ["_sheet", "b"])
        own = F.struct("a", "b")
        chosen = materialize(ranked.filter((F.col("of_a") == own) & (F.col("of_b") == own)).select("_sheet", "a", "b", "iou"), "chosen")
        after = left.join(chosen.select("_sheet", "a"), ["_sheet", "a"], "left_anti").join(chosen.select("_sheet", "b"), ["_sheet", "b"], "left_anti")
        after = materialize(after.select("_sheet", "a", "b", "iou"), "pairs")
        remove(left)
        kept.append(chosen)
        left = after
    out = left
    for chosen in kept:
        out = out.unionByName(chosen)
    return out.select(F.col("_sheet").alias(sheet), "a", "b", "iou")
