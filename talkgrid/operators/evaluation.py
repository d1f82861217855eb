"""Evaluation: error rates, precision and recall, threshold sweeps, percentiles and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions import text as T


def low_density(segments: DataFrame, least_ms: int = 3000, most_chars: int = 2) -> DataFrame:
    """Long segments with next to no letters or digits: number and whole seconds a note."""
    span = F.col("end_ms") - F.col("start_ms")
    rows = segments.where((span >= least_ms) & (F.char_length(T.effective(F.col("text"))) <= most_chars))
    return rows.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum(span) / 1000).cast("long").alias("seconds"))


def error_rate(pairs: DataFrame, key: str) -> DataFrame:
    """Edit distances summed by reference lengths summed; groups without reference characters are left out."""
    g = pairs.groupBy(key).agg(F.sum(F.levenshtein("reference", "hypothesis")).alias("errors"), F.sum(F.char_length("reference")).alias("chars"))
    return g.where("chars > 0").withColumn("cer", F.round(F.col("errors") / F.col("chars"), 6))


def precision_recall(rows: DataFrame) -> DataFrame:
    """rows: want, got (null: no prediction). correct / (correct + wrong) and correct / labelled, 0 on none."""
    right = F.count_if(F.col("want") == F.col("got"))
    told = F.count("got")
    every = F.count(F.lit(1))
    return rows.agg(every.alias("labeled"), right.alias("correct"), F.round(right / F.greatest(F.lit(1), told), 6).alias("precision"), F.round(right / F.greatest(F.lit(1), every), 6).alias("recall"))


def threshold_sweep(scores: DataFrame) -> DataFrame:
    """False accepts and rejects at thresholds -0.20 to 1.00 by 0.01.

    A score counts for all thresholds up to its own; so scores are reduced to their threshold step first, and the
    sweep is a running sum over at most 123 steps.
    """
    step = F.greatest(F.lit(-21), F.least(F.lit(101), F.floor(F.round(F.col("score") * 100, 6))))
    by = scores.where("score is not null").groupBy(step.alias("step")).agg(F.count_if(~F.col("same")).alias("other"), F.count_if(F.col("same")).alias("same"))
    grid = scores.sparkSession.range(-21, 102).withColumnRenamed("id", "step").join(by, "step", "left").fillna(0, ["other", "same"])
    up = Window.orderBy("step").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    down = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    out = grid.select("step", F.sum("other").over(up).alias("false_accepts"), F.coalesce(F.sum("same").over(down), F.lit(0)).alias("false_rejects"))
    return out.where("step between -20 and 100").select((F.col("step") / 100.0).alias("threshold"), "false_accepts", "false_rejects")


def nearest_rank(df: DataFrame, key: str, value: str, ranks: dict[str, float]) -> DataFrame:
    """Elements round((n - 1) p) of each group's sorted values; values are counted first, then ranked by running counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).count()
    w = Window.partitionBy(key).orderBy(value)
    upto = counts.withColumns({"upto": F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n": F.sum("count").over(Window.partitionBy(key))})
    pick = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p + 0.5), F.col(value)))
    return upto.groupBy(key).agg(*[pick(p).alias(n) for n, p in ranks.items()])


def engine_summary(df: DataFrame, key: str) -> DataFrame:
    """Rows, rows with a reference, and elapsed by audio time over all rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count("reference").alias("scored"), F.round(F.sum("elapsed_ms") / F.sum("audio_ms"), 6).alias("rtf"))


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """Values that occur more than once, blanks left out."""
    return df.where(F.trim(name) != "").groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
