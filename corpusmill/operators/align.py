"""Alignment of items with text segments: greedy, and one-to-one with the largest total similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import segments
from corpusmill.functions.vectors import dot

MIN_SIMILARITY = 0.18


def segment_rows(df: DataFrame, figure: str, caption: str, **options) -> DataFrame:
    """(figure, seg_idx, text): the segments of each caption in order."""
    return df.select(figure, F.posexplode(segments(F.col(caption), **options)).alias("seg_idx", "text"))


def greedy_align(panels: DataFrame, segs: DataFrame, figure: str = "figure_id", panel: str = "panel_id", seg: str = "seg_idx", text: str | None = "text", digits: int | None = None) -> DataFrame:
    """Each panel's best segment of its figure, independent of the others, with the runner-up, margin and match type.

    Similarities are inner products of the columns ``embedding``; ties go to the smaller segment index.  Panels of
    figures without segments are left out.  Candidates stay within a figure; a panel's own candidates are ranked.
    """
    a = panels.select(figure, panel, F.col("embedding").alias("_p"))
    b = segs.select(figure, F.col(seg).alias("_seg"), (F.col(text) if text else F.lit(None).cast("string")).alias("_text"), F.col("embedding").alias("_s"))
    sim = dot(F.col("_p"), F.col("_s"))
    scored = a.join(b, figure).select(figure, panel, "_seg", "_text", (F.round(sim, digits) if digits is not None else sim).alias("_sim"))
    w = Window.partitionBy(figure, panel).orderBy(F.desc("_sim"), F.asc("_seg"))
    ranked = scored.withColumns({"_r": F.row_number().over(w), "_next": F.lead("_sim").over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(figure, panel))})
    best = ranked.filter("_r = 1")
    return best.select(
        figure,
        panel,
        F.col("_seg").alias("best_segment"),
        F.col("_text").alias("best_match_text"),
        F.col("_sim").alias("best_similarity"),
        F.col("_next").alias("second_best_similarity"),
        (F.col("_sim") - F.col("_next")).alias("similarity_margin"),
        F.col("_n").alias("n_candidate_segments"),
        F.when(F.col("_n") > 1, F.lit("panel_specific")).otherwise(F.lit("figure_level_caption")).alias("match_type"),
    )


def best_assignment(similarity: np.ndarray) -> np.ndarray:
    """For each row of a matrix with no more rows than columns, its column in an assignment of largest total.

    Successive shortest paths on reduced costs: rows enter one by one, and each search relaxes whole rows at a time.
    """
    cost = similarity.max(initial=0) - np.asarray(similarity, np.float64)
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    row_price, column_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for entering in range(n):
        distance = cost[entering] - row_price[entering] - column_price
        came_from = np.full(m, entering)
        settled = np.zeros(m, bool)
        while True:
            open_distance = np.where(settled, np.inf, distance)
            at = int(open_distance.argmin())
            reach = distance[at]
            if row_of[at] < 0:
                break
            settled[at] = True
            row = row_of[at]
            through = reach + cost[row] - row_price[row] - column_price
            better = ~settled & (through < distance)
            distance[better], came_from[better] = through[better], row
        gain = reach - distance[settled]
        row_price[row_of[settled]] += gain
        column_price[settled] -= gain
        row_price[entering] += reach
        column_of = np.full(n, -1)
        column_of[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
        while True:
            row = came_from[at]
            row_of[at], column_of[row], at = row, at, column_of[row]
            if row == entering:
                break
    out = np.empty(n, np.int64)
    out[row_of[row_of >= 0]] = np.flatnonzero(row_of >= 0)
    return out


ASSIGNED = "figure_id string, panel_id string, assigned_segment_text string, assigned_similarity double, alignment_mode string"


def _solve(panels: pd.DataFrame, segs: pd.DataFrame) -> list[tuple]:
    """(panel, text, similarity, mode) of one figure."""
    panels = panels.sort_values("panel_id")
    ids = panels.panel_id.tolist()
    if not len(segs):  # a side without rows may come without columns
        return [(i, None, None, "no_candidate_text") for i in ids]
    segs = segs.sort_values("seg_idx")
    texts = segs.text.tolist()
    sim = np.array(panels.embedding.tolist(), np.float64) @ np.array(segs.segment_vector.tolist(), np.float64).T
    if len(texts) == 1:
        return [(i, texts[0], s, "shared_caption") for i, s in zip(ids, sim[:, 0].tolist(), strict=True)]
    if len(texts) >= len(ids):
        taken = dict(enumerate(best_assignment(sim).tolist()))
    else:
        taken = {panel: seg for seg, panel in enumerate(best_assignment(sim.T).tolist())}
    out = []
    for row, panel in enumerate(ids):
        seg = taken.get(row)
        mode = "assigned_distinct" if seg is not None else "shared_segment_insufficient"
        seg = int(sim[row].argmax()) if seg is None else seg
        out.append((panel, texts[seg], float(sim[row, seg]), mode))
    return out


def assign(panels: DataFrame, segs: DataFrame, floor: float = MIN_SIMILARITY) -> DataFrame:
    """(figure_id, panel_id, assigned_segment_text, assigned_similarity, alignment_mode), a row for every panel.

    Inside a figure distinct segments go to distinct panels so that the total similarity is largest; panels left over
    take their best segment.  Below ``floor`` the text is withdrawn.  Figures are groups of their own, of a handful of
    rows, so they are solved in parallel; ties between equally good assignments may fall either way.
    """

    def group(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = _solve(a, b) if len(a) else []
        figure = a.figure_id.iloc[0] if len(a) else None
        return pd.DataFrame([(figure, *r) for r in rows], columns=["figure_id", "panel_id", "assigned_segment_text", "assigned_similarity", "alignment_mode"])

    left = panels.select(F.col("figure_id").cast("string"), F.col("panel_id").cast("string"), "embedding")
    # both sides may come from one table, so the vectors need names of their own
    right = segs.select(F.col("figure_id").cast("string"), "seg_idx", "text", F.col("embedding").alias("segment_vector"))
    out = left.groupBy("figure_id").cogroup(right.groupBy("figure_id")).applyInPandas(group, ASSIGNED)
    return with_floor(out, floor)


def with_floor(df: DataFrame, floor: float = MIN_SIMILARITY) -> DataFrame:
    """Assignments below ``floor`` become 'unmatched' and lose their text, not their similarity."""
    low = F.coalesce(F.col("assigned_similarity") < floor, F.lit(False))
    return df.withColumns(
        {
            "assigned_segment_text": F.when(~low, F.col("assigned_segment_text")),
            "alignment_mode": F.when(low, F.lit("unmatched")).otherwise(F.col("alignment_mode")),
        }
    )


def figure_modes(df: DataFrame) -> DataFrame:
    """(figure_id, figure_mode): what the modes of a figure's panels add up to."""
    modes = F.collect_set("alignment_mode")
    grouped = df.groupBy("figure_id").agg(modes.alias("modes"))
    has = lambda m: F.array_contains("modes", m)
    return grouped.select(
        "figure_id",
        F.when(has("shared_segment_insufficient"), F.lit("partially_shared"))
        .when(has("assigned_distinct"), F.lit("fully_distinct"))
        .when(has("shared_caption"), F.lit("shared_caption"))
        .when(has("no_candidate_text"), F.lit("no_candidate_text"))
        .otherwise(F.lit("other"))
        .alias("figure_mode"),
    )


def is_panel_specific(mode: Column) -> Column:
    """Whether a mode's text says something about its own panel."""
    return ~F.coalesce(mode.isin("shared_caption", "unmatched", "no_candidate_text"), F.lit(False))
