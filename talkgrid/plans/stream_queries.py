"""Batch equivalents of the streaming operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.plans import views as V
from talkgrid.plans.registry import query
from talkgrid.streaming import alarms, echo


def _events(spark, d):
    s = V.segments(spark, d)
    mic = F.col("seq") % 2 == 0
    return s.select("note_id", F.col("end_ms").alias("at_ms"), F.lit("final").alias("kind"), F.when(mic, "mic").otherwise("system").alias("source"), "seq", "start_ms", "end_ms", "text", F.when(F.col("seq") % 6 == 0, 0.01).otherwise(0.1).alias("rms"))


@query(None)
def echo_operations(spark, d):
    """Turns stand for the two sources' finals."""
    return echo.dedup_batch(_events(spark, d))


@query(None)
def system_finals(spark, d):
    """At a stream's end every final is out, and what is left of the microphone's is no echo of the system's."""
    ops = echo.dedup_batch(_events(spark, d))
    return echo.settled(ops).withColumn("system", F.col("seq") % 2 == 1).groupBy("note_id").agg(F.count_if("system").alias("system"), F.count_if(~F.col("system")).alias("mic"))


@query(None)
def gap_alarm_edges(spark, d):
    """T14, T15"""
    e = V.table(spark, d, "events").select((F.col("user_id") % 10).alias("source"), F.unix_timestamp(F.to_timestamp("ts")).cast("double").alias("t_s"), (F.col("value") / 100).alias("gap_s"))
    return alarms.gap_alarms(e)


@query("SELECT user_id AS source, time_bucket(INTERVAL 30 MINUTE, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def live_windows(spark, d):
    """T09, T20"""
    e = V.table(spark, d, "events").select(F.col("user_id").alias("source"), "ts", "value")
    return alarms.tumbling(e, "30 minutes").withColumn("total", F.round("total", 4))
