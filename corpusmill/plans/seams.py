"""Seams for models that run outside the engine: batch scoring with resume and captured failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from corpusmill.operators.joins import pending


def score(df: DataFrame, predict: Callable[[pd.DataFrame], list], column: str = "prediction", batch: int = 64) -> DataFrame:
    """``df`` with a text column from a model called on batches of at most ``batch`` rows.

    A batch that fails is called again row by row; a row that fails gets ``[ERROR: ...]``.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    answers = list(predict(part))
                except Exception:  # noqa: BLE001
                    answers = [_one(predict, part.iloc[i : i + 1]) for i in range(len(part))]
                yield part.assign(**{column: answers})

    return df.mapInPandas(rows, StructType([*df.schema.fields, StructField(column, StringType())]))


def _one(predict, row: pd.DataFrame):
    try:
        return next(iter(predict(row)))
    except Exception as error:  # noqa: BLE001
        return f"[ERROR: {error}]"


def resume(df: DataFrame, done: DataFrame | None, keys: list[str], predict, **options) -> DataFrame:
    """Scores of the rows that are not done yet; append them to the table of results."""
    return score(df if done is None else pending(df, done, keys), predict, **options)
