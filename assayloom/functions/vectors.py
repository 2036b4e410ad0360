"""Column functions for dense vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def standardized(v: Column, mean: Column, scale: Column) -> Column:
    """(v - mean) / scale by position; raises if lengths differ."""
    fine = (F.size(v) == F.size(mean)) & (F.size(v) == F.size(scale))
    out = F.zip_with(F.zip_with(v, mean, lambda x, m: x.cast("double") - m), scale, lambda x, s: x / s)
    return F.when(fine, out).otherwise(F.raise_error(F.lit("vector and scaler differ in length")).cast("array<double>"))


def one_hot(value: Column, choices: list) -> Column:
    """One slot a choice and a last one for anything else."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, choices)), value), F.lit(0)), F.lit(len(choices) + 1))
    return F.transform(F.sequence(F.lit(1), F.lit(len(choices) + 1)), lambda i: (i == at).cast("double"))


def popcount_and(a: Column, b: Column) -> Column:
    """Common set bits of two bit sets held as arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


def probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))
