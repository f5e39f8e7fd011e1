"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null when the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(a: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two integers."""
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(a: Column, bits: int = 63) -> Column:
    """A perceptual-hash stand-in: bit i is set when component i is positive."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(bits)),
        F.lit(0).cast("long"),
        lambda h, i: h + F.when(F.element_at(a, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)).otherwise(F.lit(0).cast("long")),
    )
