"""Date, time and interval functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Shared length by the length of the first; 0 for an empty one."""
    return F.when(a1 > a0, overlap(a0, a1, b0, b1) / (a1 - a0)).otherwise(0.0)


def time_near(a0: Column, a1: Column, b0: Column, b1: Column, window_ms: int = 2500) -> Column:
    """Closed overlap, or starts less than a window apart."""
    return ((a0 <= b1) & (b0 <= a1)) | (F.abs(a0 - b0) < window_ms)


def intervals_overlap(f1: Column, t1: Column, f2: Column, t2: Column) -> Column:
    """Strict half-open overlap; a null bound is unbounded."""
    return (f1.isNull() | t2.isNull() | (f1 < t2)) & (f2.isNull() | t1.isNull() | (f2 < t1))


def in_bounds(valid_from: Column, valid_to: Column, low: str | None, high: str | None) -> Column:
    """Inclusive overlap with bounds, each optional; null ends and unparsable bounds pass."""
    ok = F.lit(True)
    if low is not None:
        at = F.try_to_timestamp(F.lit(low))
        ok = ok & (valid_to.isNull() | at.isNull() | (valid_to >= at))
    if high is not None:
        at = F.try_to_timestamp(F.lit(high))
        ok = ok & (valid_from.isNull() | at.isNull() | (valid_from <= at))
    return ok


def status_as_of(valid_to: Column, now: str) -> Column:
    """historical once its end is reached, else current; an unparsable end is current."""
    return F.when(valid_to <= F.to_timestamp(F.lit(now)), "historical").otherwise("current")


def duration_bucket(s: Column) -> Column:
    return F.when(s < 300, "<5m").when(s < 1800, "5-30m").when(s < 3600, "30-60m").otherwise(">1h")


def ms_to_samples(ms: Column, rate: int = 16_000) -> Column:
    return F.floor(ms * rate / 1000).cast("long")


def samples_to_ms(n: Column, rate: int = 16_000) -> Column:
    return F.floor(n * 1000 / rate).cast("long")
