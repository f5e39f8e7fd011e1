"""Labelled samples of bounded size for the classifiers of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_column.cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, bound: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, label, text), at most ``bound`` rows, of labelled ids outside the held-out fold.

    Ids with several labels count by their majority (a tie is a 1); null labels are none.  The ids are those with the
    smallest hashes, so the choice depends on nothing else; they are few enough to broadcast.  Of several rows with one
    id the smallest text counts; only the sample's texts are shuffled.
    """
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("double").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
