"""Compound-item cues, signal buckets and the tiered policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Measured precision, tier and decision of each signal bucket.
PRECISION = {"caption_word_only": 0.575, "aspect_only": 0.825, "caption_letter_only": 0.925, "both_signals": 0.975, "caption_letter_and_word": 1.0}
TIERS = {
    "both_signals": "high_confidence",
    "caption_letter_and_word": "high_confidence",
    "caption_letter_only": "high_confidence",
    "aspect_only": "medium_confidence",
    "caption_word_only": "rejected",
    "unflagged": "not_flagged",
}
COMPOUND_TIERS = {"high_confidence": True, "medium_confidence": True, "rejected": False, "not_flagged": False}


def caption_cues(c: Column, letters: str = T.PANEL_LETTERS, letter_list: str = T.PANEL_LETTER_LIST, word: str = T.PANEL_WORD) -> Column:
    """Reasons in fixed order: marker count (from 2), a list of letters, a panel word; none for null and empty texts."""
    text = F.coalesce(c, F.lit(""))
    n = F.regexp_count(text, F.lit(letters))
    return F.array_compact(
        F.array(
            F.when(n >= 2, F.concat(F.lit("panel_letters_x"), n.cast("string"))),
            F.when(F.regexp_like(text, F.lit(letter_list)), F.lit("panel_letter_list")),
            F.when(F.regexp_like(text, F.lit(word)), F.lit("panel_word")),
        )
    )


def aspect_ratio(width: Column, height: Column) -> Column:
    """Width by height to four digits; null for a missing or zero height."""
    return F.round(F.try_divide(width.cast("double"), height.cast("double")), 4)


def aspect_cue(width: Column, height: Column, wide: float = 1.8, tall: float = 0.5) -> Column:
    """'wide_aspect_R' or 'tall_aspect_R'; null between the limits and for missing or zero sides."""
    ratio = F.when((width != 0) & (height != 0), F.try_divide(width.cast("double"), height.cast("double")))
    shown = F.format_string("%.2f", ratio)
    return F.when(ratio >= wide, F.concat(F.lit("wide_aspect_"), shown)).when(ratio <= tall, F.concat(F.lit("tall_aspect_"), shown))


def reasons(caption: Column, aspect: Column) -> Column:
    """Caption cues followed by the aspect cue."""
    return F.array_compact(F.concat(caption, F.array(aspect)))


def signal_bucket(found: Column) -> Column:
    """The bucket of a reason list: a caption and an aspect cue together, letters with words, then each alone."""
    given = F.coalesce(found, F.array().cast("array<string>"))
    letter = F.exists(given, lambda r: r.rlike("^(panel_letters_x[0-9]+|panel_letter_list)$"))
    word = F.array_contains(given, "panel_word")
    aspect = F.exists(given, lambda r: r.startswith("wide_aspect_") | r.startswith("tall_aspect_"))
    return (
        F.when(aspect & (letter | word), F.lit("both_signals"))
        .when(letter & word, F.lit("caption_letter_and_word"))
        .when(letter, F.lit("caption_letter_only"))
        .when(word, F.lit("caption_word_only"))
        .when(aspect, F.lit("aspect_only"))
        .otherwise(F.lit("unflagged"))
    )


def lookup(c: Column, table: dict) -> Column:
    """A dictionary lookup; null for a missing key."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*flat)[c]


def apply_policy(df: DataFrame, reasons_col: str = "compound_reasons", tiers: dict = TIERS, decisions: dict = COMPOUND_TIERS, precision: dict = PRECISION) -> DataFrame:
    """``df`` with signal_bucket, compound_tier, compound_flag_v2 and compound_tier_precision_est."""
    bucketed = df.withColumn("signal_bucket", signal_bucket(F.col(reasons_col)))
    tiered = bucketed.withColumn("compound_tier", lookup(F.col("signal_bucket"), tiers))
    return tiered.withColumns({"compound_flag_v2": lookup(F.col("compound_tier"), decisions), "compound_tier_precision_est": lookup(F.col("signal_bucket"), precision)})


def bucket_precision(df: DataFrame, bucket: str, truth: str) -> DataFrame:
    """(bucket, reviewed, precision): the share of reviewed rows for which the truth holds; null truths are not reviewed."""
    return df.filter(F.col(truth).isNotNull()).groupBy(bucket).agg(F.count(F.lit(1)).alias("reviewed"), F.avg(F.col(truth).cast("double")).alias("precision"))
