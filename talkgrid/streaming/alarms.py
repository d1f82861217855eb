"""Windowed alarms, rate filters and live aggregates over streams of events."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GapAlarm:
    """Fires once when gaps take over a share of a full sliding window, and recovers once when they no longer do."""

    def __init__(self, window_s: float = 60.0, share: float = 0.05):
        self.window, self.share, self.gaps, self.first, self.on = window_s, share, deque(), None, False
        self.total_ns = 0  # whole nanoseconds, so that a running sum stays exact

    def push(self, t: float, gap_s: float) -> str | None:
        self.first = t if self.first is None else self.first
        self.gaps.append((t, round(gap_s * 1e9)))
        self.total_ns += self.gaps[-1][1]
        while self.gaps and self.gaps[0][0] <= t - self.window:
            self.total_ns -= self.gaps.popleft()[1]
        high = t - self.first >= self.window and self.total_ns / 1e9 / self.window > self.share
        if high != self.on:
            self.on = high
            return "fired" if high else "recovered"
        return None


def gap_alarms(events: DataFrame) -> DataFrame:
    """events: source, t_s, gap_s. Edges (source, t_s, edge), in order, of every source."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        alarm, out = GapAlarm(), []
        for r in g.sort_values("t_s").itertuples():
            if (edge := alarm.push(r.t_s, r.gap_s)) is not None:
                out.append((r.source, r.t_s, edge))
        return pd.DataFrame(out, columns=["source", "t_s", "edge"])

    return events.groupBy("source").applyInPandas(run, "source long, t_s double, edge string")


class RateFilter:
    """Second-order loop that follows a clock: rate and phase; an error over 5 ms starts it anew."""

    def __init__(self, bandwidth_hz: float = 0.05, reanchor_s: float = 0.005):
        self.w, self.limit, self.t, self.rate, self.reanchors = 2 * 3.141592653589793 * bandwidth_hz, reanchor_s, None, 1.0, 0

    def push(self, expected_s: float, dt_s: float) -> float:
        """Takes the observed time after a step of dt; the estimated rate in parts per million."""
        if self.t is None:
            self.t = expected_s
            return 0.0
        self.t += dt_s * self.rate
        e = expected_s - self.t
        if abs(e) > self.limit:
            self.t, self.reanchors = expected_s, self.reanchors + 1
        else:
            self.t += 2**0.5 * self.w * dt_s * e
            self.rate += (self.w * dt_s) ** 2 / dt_s * e
        return (self.rate - 1) * 1e6


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by source and window; on a stream, late rows count until the watermark has passed."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy("source", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("source", F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    src = events.withWatermark("ts", late) if events.isStreaming else events
    return src.groupBy("source", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rates(rows: Iterator[tuple[float, float]]) -> list[float]:
    f = RateFilter()
    return [f.push(t, d) for t, d in rows]
