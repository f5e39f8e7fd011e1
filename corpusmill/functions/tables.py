"""Functions for SQL: a table function with PARTITION BY and a grouped Arrow aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@F.udtf
class PackRows:
    """``pack_rows(budget => n, rows => TABLE(t) PARTITION BY keys ORDER BY item)``: consecutive rows of a partition in packs.

    The table has ``item`` and ``size``; its other columns are keys, which the result repeats with their own types.  A row
    joins the open pack if the sizes stay within ``budget``, otherwise it opens the next one; a larger row is a pack of
    its own.  A null size is 0.  Result: keys, pack (from 0), n_items, total, first_item, last_item.

    State is one pack, but each partition is read by one task, so keys should split what may be large.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"item", "size"} <= set(rows.dataType.names):
            raise ValueError("pack_rows needs a table with the columns item and size")
        if budget.isTable or not budget.isConstantExpression or not isinstance(budget.value, int) or budget.value < 0:
            raise ValueError("pack_rows needs a budget, a constant whole number of 0 or more")
        keys = [f for f in rows.dataType.fields if f.name not in ("item", "size")]
        counts = [StructField(n, LongType()) for n in ("pack", "n_items", "total")]
        ends = [StructField(n, rows.dataType["item"].dataType) for n in ("first_item", "last_item")]
        return AnalyzeResult(StructType(keys + counts + ends))

    def __init__(self) -> None:
        self.keys: tuple | None = None
        self.pack = self.n = self.total = 0
        self.first = self.last = None

    def eval(self, rows: Row, budget: int) -> Iterator[tuple]:
        if self.keys is None:
            self.keys = tuple(v for c, v in rows.asDict().items() if c not in ("item", "size"))
        size = rows["size"] or 0
        if self.n and self.total + size > budget:
            yield self._packed()
            self.pack, self.n, self.total = self.pack + 1, 0, 0
        if not self.n:
            self.first = rows["item"]
        self.n, self.total, self.last = self.n + 1, self.total + size, rows["item"]

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self._packed()

    def _packed(self) -> tuple:
        return (*self.keys, self.pack, self.n, self.total, self.first, self.last)


def entropy_bits(n: pa.Array) -> float:
    """Entropy in bits of a distribution given by its counts; null and zero counts say nothing, none at all is 0.

    A group is one Arrow array, so counts are to be summed by SQL first.
    """
    counts = n.drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
    counts = counts[counts > 0]
    total = counts.sum()
    return float(np.log2(total) - (counts * np.log2(counts)).sum() / total) if total else 0.0


def register(spark: SparkSession) -> None:
    """``pack_rows`` and ``entropy_bits`` by these names in the session's SQL."""
    spark.udtf.register("pack_rows", PackRows)
    spark.udf.register("entropy_bits", F.arrow_udf(entropy_bits, DoubleType()))
