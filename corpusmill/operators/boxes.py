"""Boxes: polygons, validity, reading order, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import reading_label


def polygon_box(points: Column, width: Column, height: Column) -> Column:
    """struct(cx, cy, bw, bh): the polygon's bounding box, clamped to the image and relative to it; null when it is empty."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    zero = F.lit(0.0)
    x1, x2 = F.greatest(zero, F.array_min(xs)), F.least(width.cast("double"), F.array_max(xs))
    y1, y2 = F.greatest(zero, F.array_min(ys)), F.least(height.cast("double"), F.array_max(ys))
    box = F.struct(((x1 + x2) / 2 / width).alias("cx"), ((y1 + y2) / 2 / height).alias("cy"), ((x2 - x1) / width).alias("bw"), ((y2 - y1) / height).alias("bh"))
    return F.when((x2 > x1) & (y2 > y1), box)


def polygons_to_boxes(df: DataFrame, keys: list[str], subfigures: str = "subfigures", width: str = "width", height: str = "height") -> DataFrame:
    """(keys, box_no, cx, cy, bw, bh): a row for every polygon with an area; degenerate polygons are left out."""
    each = df.select(*keys, width, height, F.posexplode(subfigures).alias("box_no", "part"))
    boxed = each.select(*keys, "box_no", polygon_box(F.col("part.points"), F.col(width), F.col(height)).alias("box"))
    return boxed.filter("box is not null").select(*keys, "box_no", "box.cx", "box.cy", "box.bw", "box.bh")


def absolute_box(cx: Column, cy: Column, bw: Column, bh: Column, width: Column, height: Column) -> Column:
    """struct(x1, y1, x2, y2) in pixels from a relative box."""
    return F.struct(((cx - bw / 2) * width).alias("x1"), ((cy - bh / 2) * height).alias("y1"), ((cx + bw / 2) * width).alias("x2"), ((cy + bh / 2) * height).alias("y2"))


def valid_box(cx: Column, cy: Column, bw: Column, bh: Column, strict: bool = True) -> Column:
    """Centre inside the image and sides in (0, 1]; not ``strict``: all four between 0 and 1.  Null counts as invalid."""
    inside = cx.between(0, 1) & cy.between(0, 1)
    sides = (bw > 0) & (bw <= 1) & (bh > 0) & (bh <= 1) if strict else bw.between(0, 1) & bh.between(0, 1)
    return F.coalesce(inside & sides, F.lit(False))


def tiny_box(bw: Column, bh: Column, limit: float = 0.05) -> Column:
    return (bw < limit) | (bh < limit)


def parse_box_line(line: Column) -> Column:
    """struct(class, cx, cy, bw, bh) of an annotation line; null unless it has five numbers."""
    parts = F.split(F.trim(line), r"\s+")
    number = [F.try_element_at(parts, F.lit(i + 1)).try_cast("double") for i in range(5)]
    whole = (F.size(parts) == 5) & number[0].isNotNull() & number[1].isNotNull() & number[2].isNotNull() & number[3].isNotNull() & number[4].isNotNull()
    return F.when(whole, F.struct(number[0].cast("int").alias("class"), *(n.alias(x) for n, x in zip(number[1:], ("cx", "cy", "bw", "bh"), strict=True))))


def box_line(cx: Column, cy: Column, bw: Column, bh: Column) -> Column:
    """An annotation line: class 0 and four numbers with six digits."""
    return F.format_string("0 %.6f %.6f %.6f %.6f", cx, cy, bw, bh)


def panel_bucket(n: Column) -> Column:
    return F.when(n >= 4, F.lit("4+")).otherwise(n.cast("string"))


def panel_category(n: Column) -> Column:
    return F.when(n >= 3, F.lit("3+")).otherwise(n.cast("string"))


def reading_order(df: DataFrame, figure: str, x1: str, y1: str, x2: str, y2: str, height: str, ties: list[str], tolerance: float = 0.12) -> DataFrame:
    """``df`` with ``position`` (from 0) and ``label``: rows from the top, boxes of a row from the left.

    From the top down a box joins the first row whose mean centre is closer than ``tolerance`` times the height, or
    starts a row.  A fold over each figure's boxes, which are few; ties are settled by the columns ``ties``.
    """
    columns = df.columns
    centre = (F.col(y1) + F.col(y2)) / 2
    boxes = F.array_sort(F.collect_list(F.struct(centre.cast("double").alias("yc"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(ties)), F.col(x1).cast("double").alias("x"), F.struct(*columns).alias("row"))))
    grouped = df.groupBy(figure).agg(boxes.alias("boxes"), F.max(F.col(height).cast("double")).alias("h"))
    state = "struct<rows: array<struct<total: double, n: int>>, places: array<int>>"
    start = F.from_json(F.lit('{"rows": [], "places": []}'), state)
    limit = F.col("h") * tolerance

    def put(acc: Column, box: Column) -> Column:
        fits = F.transform(acc["rows"], lambda r: F.abs(box["yc"] - r["total"] / r["n"]) < limit)
        at = F.array_position(fits, True).cast("int")
        grown = F.transform(acc["rows"], lambda r, i: F.when(i + 1 == at, F.struct((r["total"] + box["yc"]).alias("total"), (r["n"] + 1).cast("int").alias("n"))).otherwise(r))
        added = F.concat(acc["rows"], F.array(F.struct(box["yc"].alias("total"), F.lit(1).alias("n"))))
        return F.struct(
            F.when(at > 0, grown).otherwise(added).alias("rows"),
            F.concat(acc["places"], F.array(F.when(at > 0, at).otherwise(F.size(acc["rows"]) + 1).cast("int"))).alias("places"),
        )

    placed = grouped.select("boxes", F.aggregate("boxes", start, put).alias("fold"))
    ranked = F.array_sort(F.transform("boxes", lambda b, i: F.struct(F.element_at(F.col("fold.places"), i + 1).alias("line"), b["x"].alias("x"), i.alias("i"), b["row"].alias("row"))))
    out = placed.select(F.posexplode(ranked).alias("position", "box"))
    return out.select(*(F.col(f"box.row.{c}") for c in columns), "position", reading_label(F.col("position")).alias("label"))


def grid_layout(n: Column, index: Column, cell_width: int = 448, cell_height: int = 448, label_height: int = 28) -> Column:
    """struct(columns, rows, x, y): the place of tile ``index`` on a sheet of ``n`` tiles, three to a row at most."""
    columns = F.least(F.lit(3), n)
    row, column = F.floor(index / columns), index % columns
    return F.struct(
        columns.cast("long").alias("columns"),
        F.ceil(n / columns).cast("long").alias("rows"),
        (column * cell_width).cast("long").alias("x"),
        (row * (cell_height + label_height) + label_height).cast("long").alias("y"),
    )


def quantiles(df: DataFrame, columns: list[str], points: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95), accuracy: int | None = None) -> DataFrame:
    """(column, n, low, high, mean, q05, ...): linear quantiles of each column, nulls left out.

    They are exact, which holds the counts of all different values of a column in one task.  For columns with too many
    of them, ``accuracy`` takes a sketch instead, with ranks off by at most one in ``accuracy``.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*").filter("v is not null")
    at = (lambda p: F.percentile_approx("v", p, accuracy)) if accuracy else (lambda p: F.percentile("v", F.lit(p)))
    qs = [at(p).alias(f"q{int(round(100 * p)):02d}") for p in points]
    return long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), *qs)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal-width bins 1 to ``bins``, the last closed; values are clipped to the range first."""
    clipped = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(value)))
    at = F.least(F.lit(bins), (F.floor((clipped - low) / ((high - low) / bins)) + 1).cast("int"))
    return df.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes given as columns ``{a}x1 .. {a}y2`` and ``{b}x1 .. {b}y2``; 0 without an area."""
    side = lambda d: F.greatest(F.least(F.col(f"{a}{d}2"), F.col(f"{b}{d}2")) - F.greatest(F.col(f"{a}{d}1"), F.col(f"{b}{d}1")), F.lit(0.0))
    area = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    shared = side("x") * side("y")
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def match_detections(found: DataFrame, truth: DataFrame, image: str = "image", thresholds: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(threshold, image, box, confidence, hit) of every detection at every threshold.

    ``found`` has (image, box, confidence, x1, y1, x2, y2), ``truth`` (image, box, x1, y1, x2, y2).  Within an image the
    surest detection takes the free true box that it overlaps most, then the next one; ties go by box.  The greedy turns
    run over the pairs of one image that overlap enough, gathered as arrays of their few boxes.
    """
    t = truth.select(F.col(image).alias("_image"), F.col("box").alias("true_box"), *(F.col(c).alias(f"t{c}") for c in ("x1", "y1", "x2", "y2")))
    least = min(thresholds)
    met = found.join(t, F.col(image) == F.col("_image")).withColumn("iou", overlap("", "t")).filter(F.col("iou") >= least)
    levels = F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold")
    pairs = met.select(levels, image, "box", "confidence", "true_box", "iou").filter(F.col("iou") >= F.col("threshold"))
    turn = F.struct((-F.col("confidence")).alias("c"), F.col("box"), (-F.col("iou")).alias("i"), F.col("true_box"))
    gathered = pairs.groupBy("threshold", image).agg(F.array_sort(F.collect_list(turn)).alias("pairs"), F.first(F.array().cast(f"array<{dict(found.dtypes)['box']}>")).alias("no_box"), F.first(F.array().cast(f"array<{dict(truth.dtypes)['box']}>")).alias("no_true"))
    start = F.struct(F.col("no_box").alias("boxes"), F.col("no_true").alias("taken"))

    def step(state: Column, p: Column) -> Column:
        free = ~F.array_contains(state["boxes"], p["box"]) & ~F.array_contains(state["taken"], p["true_box"])
        return F.when(free, F.struct(F.array_append(state["boxes"], p["box"]).alias("boxes"), F.array_append(state["taken"], p["true_box"]).alias("taken"))).otherwise(state)

    hits = gathered.select(F.col("threshold").alias("_t"), F.col(image).alias("_i"), F.explode(F.aggregate("pairs", start, step)["boxes"]).alias("_b"))
    every = found.select(levels, image, "box", "confidence")
    out = every.join(hits, (F.col("threshold") == F.col("_t")) & (F.col(image) == F.col("_i")) & (F.col("box") == F.col("_b")), "left")
    return out.select("threshold", image, "box", "confidence", F.col("_b").isNotNull().alias("hit"))


def detection_metrics(found: DataFrame, truth: DataFrame, image: str = "image", thresholds: tuple[float, ...] = (0.5,), least_confidence: float = 0.0) -> DataFrame:
    """(threshold, n_true, n_found, hits, precision, recall, average_precision) of detections; the mean over thresholds is mAP.

    ``average_precision`` is the area below the precision envelope over recall, at every step of confidence (equal
    confidences are one step).  Steps are counted first, so the running sums see one row for each different confidence.
    """
    matched = match_detections(found.filter(F.col("confidence") >= least_confidence), truth, image, thresholds)
    total = truth.agg(F.count(F.lit(1)).alias("n_true"))
    steps = matched.groupBy("threshold", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"))
    down = Window.partitionBy("threshold").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = steps.withColumns({"found": F.sum("n").over(down), "right": F.sum("h").over(down)}).crossJoin(F.broadcast(total))
    curve = curve.withColumn("p", F.col("right") / F.col("found"))
    lower = Window.partitionBy("threshold").orderBy(F.desc("confidence")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    curve = curve.withColumn("envelope", F.max("p").over(lower))
    area = curve.groupBy("threshold").agg(
        F.sum("n").alias("n_found"), F.sum("h").alias("hits"), F.sum(F.when(F.col("n_true") > 0, F.col("envelope") * F.col("h") / F.col("n_true"))).alias("average_precision")
    )
    levels = F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold")
    every = total.select(levels, "n_true")
    out = every.join(area, "threshold", "left").na.fill(0, ["n_found", "hits"])
    share = lambda whole: F.when(F.col(whole) > 0, F.col("hits") / F.col(whole))
    return out.select(
        "threshold", "n_true", "n_found", "hits", share("n_found").alias("precision"), share("n_true").alias("recall"),
        F.when(F.col("n_true") > 0, F.coalesce("average_precision", F.lit(0.0))).alias("average_precision"),
    )
