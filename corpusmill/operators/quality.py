"""Rule-based quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The flags that reject an item; the others are notes.
DISQUALIFYING = ("panel_too_small", "extreme_aspect_ratio", "missing_alignment", "low_clip_similarity", "ambiguous_alignment")


def no_nan(c: Column) -> Column:
    """Null for NaN, so that comparisons with it are never true."""
    return F.when(~F.isnan(c), c)


def quality_flags(df: DataFrame, min_side: int = 32, min_similarity: float = 0.18, min_margin: float = 0.01, max_aspect: float = 8.0) -> DataFrame:
    """``df`` with ``quality_flags`` and ``is_flagged``.

    Reads width, height, aspect_ratio, best_similarity, similarity_margin, n_candidate_segments and match_type; missing
    values raise only 'missing_alignment'.
    """
    aspect, sim, margin = (no_nan(F.col(c).cast("double")) for c in ("aspect_ratio", "best_similarity", "similarity_margin"))
    several = F.coalesce(F.col("n_candidate_segments"), F.lit(1)) > 1
    flags = F.array_compact(
        F.array(
            F.when((F.col("width") < min_side) | (F.col("height") < min_side), F.lit("panel_too_small")),
            F.when((aspect != 0) & ((aspect > max_aspect) | (aspect < 1 / max_aspect)), F.lit("extreme_aspect_ratio")),
            F.when(sim.isNull(), F.lit("missing_alignment")).when(sim < min_similarity, F.lit("low_clip_similarity")),
            F.when((margin < min_margin) & several, F.lit("ambiguous_alignment")),
            F.when(F.col("match_type") == "figure_level_caption", F.lit("figure_level_caption_only")),
        )
    )
    rejects = F.array(*(F.lit(x) for x in DISQUALIFYING))
    return df.withColumn("quality_flags", flags).withColumn("is_flagged", F.arrays_overlap("quality_flags", rejects))


def with_group_count(df: DataFrame, group: str, member: str, name: str) -> DataFrame:
    """``df`` with the number of non-null members of each row's group."""
    return df.withColumn(name, F.count(member).over(Window.partitionBy(group)))


def split_accepted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, flagged)."""
    return df.filter("not is_flagged"), df.filter("is_flagged")


def reason_counts(df: DataFrame, column: str = "quality_flags", name: str = "reason") -> DataFrame:
    """(reason, n): how often each entry of a list column occurs."""
    return df.select(F.explode(column).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
