"""Vector functions as Column expressions on array<float>; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null where lengths differ."""
    total = F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, least: float = 1e-6) -> Column:
    """L2-normalised; null where the norm is next to zero or not a number."""
    n = norm(v)
    return F.when((n >= least) & (n < float("inf")), F.transform(as_double(v), lambda x: x / n))


def weighted_centroid(a: Column, n: Column, b: Column, m: Column) -> Column:
    """(a n + b m) / (n + m), normalised."""
    return unit(F.zip_with(as_double(a), as_double(b), lambda x, y: (x * n + y * m) / (n + m)))


def rms(v: Column) -> Column:
    """Root mean square, 0 for an empty array."""
    return F.when(F.size(v) > 0, F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x) / F.size(v))).otherwise(0.0)


def soft_limit(x: Column, knee: float = 0.95) -> Column:
    """Identity up to the knee, then e / (e + rest) of what lies above."""
    over = F.abs(x) - knee
    return F.when(F.abs(x) <= knee, x).otherwise(F.signum(x) * (knee + (1 - knee) * over / (over + (1 - knee))))
