"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def share(n: Column, of: Column) -> Column:
    """Percentage; null where the denominator is null or 0."""
    return F.when(of != 0, F.lit(100.0) * n.cast("double") / of.cast("double"))


def wilson(n: Column, of: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper Wilson score limits of n in `of`, in percent, within 0 to 100."""
    n, of = n.cast("double"), F.when(of > 0, of.cast("double"))
    p, zz = n / of, z * z
    middle = (p + zz / (2 * of)) / (1 + zz / of)
    half = z * F.sqrt(p * (1 - p) / of + zz / (4 * of * of)) / (1 + zz / of)
    bound = lambda x: F.when(of.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * x)))
    return bound(middle - half), bound(middle + half)
