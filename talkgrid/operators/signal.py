"""Signal operators on arrays and frame tables: mixing, resampling, energy, correlation and line fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions import vector as M


def mono(v: Column, channels: int) -> Column:
    """Mean over the channels of each whole frame."""
    frames = F.floor(F.size(v) / channels).cast("int")
    mean = lambda i: F.aggregate(F.slice(v, (i * channels + 1).cast("int"), channels), F.lit(0.0), lambda s, x: s + x) / channels
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), mean)).otherwise(F.expr("cast(array() as array<double>)"))


def resample(v: Column, ratio: float) -> Column:
    """round(n ratio) samples by linear interpolation; the last sample repeats."""
    n = F.floor(F.size(v) * ratio + 0.5).cast("int")

    def at(i: Column) -> Column:
        x = i / ratio
        k = F.least(F.floor(x).cast("int"), F.size(v) - 1)
        a, b = F.get(v, k), F.get(v, F.least(k + 1, F.size(v) - 1))
        return a + (b - a) * (x - k)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.expr("cast(array() as array<double>)"))


def frame_rms(v: Column, hop: int = 320) -> Column:
    """Root mean square of each whole or partial frame."""
    frames = F.ceil(F.size(v) / hop).cast("int")
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), lambda i: M.rms(F.slice(v, (i * hop + 1).cast("int"), hop))))


def waveform(samples: DataFrame, key: str, index: str, value: str, total: Column, buckets: int = 260) -> DataFrame:
    """Largest absolute sample of each of equal buckets."""
    b = F.least(F.floor(F.col(index) * buckets / total), F.lit(buckets - 1))
    return samples.groupBy(key, b.alias("bucket")).agg(F.max(F.abs(value)).alias("peak"))


def mix_below_watermark(frames: DataFrame, margin: int) -> DataFrame:
    """(position, total, sources): sums over sources at positions below the slowest source's end less a margin."""
    ends = frames.groupBy("source").agg(F.max("position").alias("end")).agg((F.min("end") - margin).alias("mark"))
    below = frames.crossJoin(F.broadcast(ends)).where("position < mark")  # one row
    return below.groupBy("position").agg(F.sum("value").alias("total"), F.countDistinct("source").alias("sources"))


def slope(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Least-squares slope and intercept of each group."""
    return df.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def piecewise(points: DataFrame, knots: DataFrame, x: str) -> DataFrame:
    """Maps x through sorted knots (x, y) by linear interpolation; beyond the ends the end pieces go on, never below 0.

    The knots of one alignment map are a short list; they come in as one array column by broadcast of a single row.
    """
    one = knots.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("k"))
    j = points.crossJoin(F.broadcast(one))  # one row
    i = F.least(F.greatest(F.size(F.filter("k", lambda p: p["x"] <= F.col(x))), F.lit(1)), F.size("k") - 1)
    a, b = F.element_at("k", i), F.element_at("k", i + 1)
    y = a["y"] + (F.col(x) - a["x"]) * (b["y"] - a["y"]) / (b["x"] - a["x"])
    return j.withColumn("y", F.greatest(F.lit(0.0), y)).drop("k")


def best_lag(a: Column, b: Column, most: int) -> Column:
    """(correlation, lag) of the best normalised cross-correlation over lags up to ``most``; ties to the smallest lag."""
    def score(lag: Column) -> Column:
        x = F.slice(a, F.greatest(lag, F.lit(0)) + 1, F.size(a))
        y = F.slice(b, F.greatest(-lag, F.lit(0)) + 1, F.size(b))
        n = F.least(F.size(x), F.size(y))
        x, y = F.slice(x, 1, n), F.slice(y, 1, n)
        d = M.norm(x) * M.norm(y)
        return F.struct(F.when(d > 0, M.dot(x, y) / d).otherwise(0.0).alias("r"), (-lag).alias("neg"))

    top = F.array_max(F.transform(F.sequence(F.lit(-most), F.lit(most)), score))
    return F.struct(F.round(top["r"], 6).alias("r"), (-top["neg"]).alias("lag"))


def gap_runs(df: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """(key, index, value, n): each row with the number of places that it fills: its own and the gap of zeros before the next
    index. Of rows with one index only the last fills any. A null index has a null n."""
    nxt = F.lead(index).over(Window.partitionBy(key).orderBy(index))
    n = F.when(F.col(index).isNotNull(), F.coalesce(nxt - F.col(index), F.lit(1)))
    return df.select(key, index, value, n.cast("long").alias("n"))


def gap_fill(df: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Missing indices between a key's first and last get 0; each row fills the gap before its successor. As many rows as there
    are places; sums and counts of them come from ``gap_runs`` without expanding them."""
    i = F.explode(F.sequence(F.col(index), F.col(index) + F.greatest(F.col("n"), F.lit(1)) - 1))
    each = gap_runs(df, key, index, value).select(key, i.alias("i"), F.col(index).alias("_i"), F.col(value).alias("_v"))
    return each.select(key, F.col("i").alias(index), F.when(F.col("i") == F.col("_i"), F.col("_v")).otherwise(0.0).alias(value))


def normalise_bands(df: DataFrame, key: str, band: str, value: str) -> DataFrame:
    """z-scores by band with population deviation; bands whose deviation is under a fifth of the median one are 0."""
    per = df.groupBy(key, band).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    mid = per.groupBy(key).agg(F.median("std").alias("mid"))
    j = df.join(per, [key, band]).join(mid, key)
    return j.withColumn("z", F.when((F.col("std") < 0.2 * F.col("mid")) | (F.col("std") == 0), 0.0).otherwise((F.col(value) - F.col("mean")) / F.col("std")))
