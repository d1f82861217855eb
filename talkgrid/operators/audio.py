"""Stateful audio operators: streaming resampling, segmenting, slope search and gap refinement of alignments, checks, gaps
of a stream and its reconnection. Classes hold one source's state; DataFrame forms run them a group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Resampler:
    """Linear resampling of a stream in pieces of any size: the samples are those of the whole stream at once.

    After n samples in, floor(n to / from) are out; sample j lies at j from / to of the input and is interpolated between its
    neighbours, where a neighbour that has not come yet counts as the one before it.
    """

    def __init__(self, source: int, target: int):
        self.step = Fraction(source, target)
        self.seen, self.out, self.last = 0, 0, 0.0

    def push(self, samples: np.ndarray) -> np.ndarray:
        x = np.asarray(samples, float)
        if not len(x) or self.step == 1:
            return x.copy()
        total = int((self.seen + len(x)) / self.step)
        # Integer positions keep long streams exact.
        at = np.arange(self.out, total, dtype=object) * self.step.numerator
        whole = np.asarray([int(a // self.step.denominator) for a in at], np.int64) - self.seen
        part = np.asarray([float(Fraction(int(a % self.step.denominator), self.step.denominator)) for a in at])
        ext = np.concatenate([[self.last], x, [x[-1]]])  # what came before, and the last sample again
        left, right = ext[np.clip(whole + 1, 0, len(x))], ext[np.clip(whole + 2, 0, len(x) + 1)]
        self.seen, self.out, self.last = self.seen + len(x), total, float(x[-1])
        return left + (right - left) * part


class Segmenter:
    """Cuts a stream into utterances: frames at least as loud as the threshold belong to one, which a silence of ``gap`` frames
    closes and which is cut where it would last longer than ``most``. Segments are padded by ``pad`` frames of what is
    around them and never overlap."""

    def __init__(self, frame: int = 160, threshold: float = 0.01, gap: int = 30, pad: int = 5, most: int = 3000, least: int = 10):
        self.frame, self.threshold, self.gap, self.pad, self.most, self.least = frame, threshold, gap, pad, most, least
        self.rest, self.at, self.first, self.last, self.end, self.done = np.zeros(0), 0, None, None, 0, []

    def accept(self, samples: np.ndarray) -> None:
        x = np.concatenate([self.rest, np.asarray(samples, float)])
        whole = len(x) // self.frame
        self.rest = x[whole * self.frame :]
        for level in np.sqrt((x[: whole * self.frame].reshape(whole, self.frame) ** 2).mean(1)) if whole else ():
            if level >= self.threshold:
                self.first = self.at if self.first is None else self.first
                self.last = self.at
            self.at += 1
            if self.first is not None and (self.at - self.last > self.gap or self.at - self.first >= self.most):
                self._close()

    def _close(self) -> None:
        if self.last - self.first + 1 >= self.least:
            start, end = max(self.end, self.first - self.pad), min(self.at, self.last + 1 + self.pad)
            self.done.append((start * self.frame, end * self.frame))
            self.end = end
        self.first = None

    def flush(self) -> None:
        if self.first is not None:
            self._close()

    def take_finished(self) -> list[tuple[int, int]]:
        out, self.done = self.done, []
        return out

    def partial(self) -> tuple[int, int] | None:
        """The utterance that is being spoken."""
        return None if self.first is None else (self.first * self.frame, self.at * self.frame)


def segment_worker(frames: Iterator[np.ndarray], channels: int, rate: int, target: int, segmenter: Segmenter, every: int) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) in samples of the target rate: finals as they close, and partials every so many samples. frames are
    interleaved."""
    resampler, seen, told = Resampler(rate, target), 0, 0
    for f in frames:
        x = np.asarray(f, float)
        x = resampler.push(x[: len(x) // channels * channels].reshape(-1, channels).mean(1))
        segmenter.accept(x)
        seen += len(x)
        for s, e in segmenter.take_finished():
            yield "final", s, e
            told = seen
        if (now := segmenter.partial()) and seen - told >= every:
            told = seen
            yield "partial", *now
    segmenter.flush()
    for s, e in segmenter.take_finished():
        yield "final", s, e


def segments_of(frames: DataFrame, channels: int, rate: int, target: int, make: Callable[[], Segmenter] = Segmenter) -> DataFrame:
    """(source, start, end): finals of each source. frames: source, seq, samples (array, interleaved); a source is one recording."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        got = [(s, e) for kind, s, e in segment_worker(iter(g["samples"]), channels, rate, target, make(), 1 << 62) if kind == "final"]
        return pd.DataFrame({"source": g["source"].iloc[0], "start": [s for s, _ in got], "end": [e for _, e in got]})

    kind = frames.schema["source"].dataType.simpleString()
    return frames.groupBy("source").applyInPandas(run, f"source {kind}, start long, end long")


# -- alignment --------------------------------------------------------------------------------------------------------


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised correlation of two equally long signals; 0 where one is silent."""
    d = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / d if d > 0 else 0.0


def best_place(window: np.ndarray, signal: np.ndarray, low: int, high: int) -> tuple[int, float, float]:
    """(place, score, second): where in low..high a window fits a signal best, and the best score away from there (by a
    tenth of the window at least). Ties go to the first place."""
    low, high = max(0, low), min(len(signal) - len(window), high)
    if high < low:
        return low, 0.0, 0.0
    scores = np.asarray([correlation(window, signal[i : i + len(window)]) for i in range(low, high + 1)])
    at = int(scores.argmax())
    away = np.abs(np.arange(len(scores)) - at) > len(window) // 10
    return low + at, float(scores[at]), float(scores[away].max()) if away.any() else 0.0


def scan_slopes(window: np.ndarray, signal: np.ndarray, centre: float, search: int, slopes: tuple[float, ...] = (0.995, 0.9975, 1.0, 1.0025, 1.005)) -> tuple[int, float, float, float]:
    """(place, score, second, slope): the window stretched by each slope and laid around the centre; the best one."""
    best = None
    for m in slopes:
        n = max(2, round(len(window) * m))
        w = np.interp(np.arange(n) / m, np.arange(len(window)), window)
        got = best_place(w, signal, int(centre) - search, int(centre) + search)
        if best is None or got[1] > best[1]:
            best = (*got, m)
    return best


def refine_gaps(knots: list[tuple[float, float]], probe: Callable[[float, float, float], tuple[float, float] | None], end: float, band: tuple[float, float], widest: float = 60.0, most: int = 64, residual: float = 0.4) -> list[tuple[float, float]]:
    """Knots with probes put into the largest gap, again and again, while one is wider than ``widest``. ``probe`` (t, predicted,
    slope) gives a knot or None. It ends with the first probe that finds none, lies beyond ``end``, or would leave one of
    its two sides with a slope outside the band (give or take what twice the residual makes of it)."""
    knots = sorted(knots)
    for _ in range(most):
        gaps = [b[0] - a[0] for a, b in zip(knots, knots[1:], strict=False)]
        if not gaps or max(gaps) <= widest:
            break
        i = len(gaps) - 1 - int(np.argmax(gaps[::-1]))
        (x0, y0), (x1, y1) = knots[i], knots[i + 1]
        slope, t = (y1 - y0) / (x1 - x0), (x0 + x1) / 2
        hit = probe(t, y0 + (t - x0) * slope, slope) if t <= end else None
        if hit is None or not x0 < hit[0] < x1:
            break
        sides = [((x0, y0), hit), (hit, (x1, y1))]
        if not all(band[0] - 2 * residual / max(1.0, q[0] - p[0]) <= (q[1] - p[1]) / (q[0] - p[0]) <= band[1] + 2 * residual / max(1.0, q[0] - p[0]) for p, q in sides):
            break
        knots.insert(i + 1, hit)
    return knots


def within_slopes(knots: list[tuple[float, float]], band: tuple[float, float], residual: float = 0.4) -> list[tuple[float, float]]:
    """Knots without those that make a slope outside the band: from the first on, a knot stays if the line from the one kept
    before it has a slope within the band, give or take what twice the residual makes of it."""
    out: list[tuple[float, float]] = []
    for x, y in sorted(knots):
        if out:
            d = x - out[-1][0]
            if d <= 0 or not band[0] - 2 * residual / max(1.0, d) <= (y - out[-1][1]) / d <= band[1] + 2 * residual / max(1.0, d):
                continue
        out.append((x, y))
    return out


class EchoDelay:
    """How late the echo of a reference comes: in windows of ``width`` samples the lag of the best correlation; a window counts
    if its correlation is high enough and stands out from the second best. The estimate is the median of the last few."""

    def __init__(self, width: int, most: int, least: float = 0.3, apart: float = 1.2, keep: int = 5):
        self.width, self.most, self.least, self.apart, self.keep = width, most, least, apart, keep
        self.ref, self.mic, self.lags = np.zeros(0), np.zeros(0), []

    def push(self, reference: np.ndarray, observed: np.ndarray) -> None:
        self.ref, self.mic = np.concatenate([self.ref, reference]), np.concatenate([self.mic, observed])
        while min(len(self.ref), len(self.mic) - self.most) >= self.width:
            at, score, second = best_place(self.ref[: self.width], self.mic, 0, self.most)
            if score >= self.least and score >= self.apart * second:
                self.lags = [*self.lags, at][-self.keep :]
            self.ref, self.mic = self.ref[self.width :], self.mic[self.width :]

    def delay(self) -> int | None:
        return int(np.median(self.lags)) if self.lags else None


def residual_peak(reference: np.ndarray, observed: np.ndarray, most: int = 800) -> float | None:
    """The largest absolute normalised correlation that is left of a reference in a signal, over lags up to ``most``; None where
    one of them is silent or too short."""
    n = min(len(reference), len(observed)) - most
    if n <= 0 or not np.any(reference) or not np.any(observed):
        return None
    return max(abs(correlation(reference[:n], observed[k : k + n])) for k in range(most + 1))


def mixed_untrusted(tracks: DataFrame, tolerance_ms: int = 500, regenerated_ms: int = 2000) -> DataFrame:
    """(note_id, reason): why a note's mixed track can't be trusted; null where it can. It must end where the sources do.

    tracks: note_id, track ('mixed', 'mic' or 'system'), offset_ms, duration_ms, sync_ms (the length by the clock, where the file
    was not measured), origin ('live' or 'regen').
    """
    length = F.coalesce("duration_ms", "sync_ms")
    source = F.col("track").isin("mic", "system")
    end = F.when(length.isNotNull(), F.coalesce("offset_ms", F.lit(0)) + length)
    mixed = F.col("track") == "mixed"
    g = tracks.groupBy("note_id").agg(F.bool_or(mixed).alias("there"), F.max(F.when(mixed, end)).alias("end"), F.max(F.when(source, end)).alias("want"), F.count_if(source & length.isNull()).alias("unknown"), F.max(F.when(mixed & (F.col("origin") == "regen"), regenerated_ms)).alias("wide"))
    far = F.abs(F.col("end") - F.col("want")) > F.coalesce("wide", F.lit(tolerance_ms))
    reason = F.when(~F.col("there"), "no mixed track").when(F.col("end").isNull(), "the mixed track's length is not known").when(F.col("unknown") > 0, "a source's length is not known").when(F.col("want").isNull(), "no source to compare with").when(far, F.concat(F.lit("ends at "), F.col("end").cast("string"), F.lit(" ms, the sources at "), F.col("want").cast("string")))
    return g.select("note_id", reason.alias("reason"))


# -- a stream's gaps --------------------------------------------------------------------------------------------------


def backfill_gap(ring_from: int, gap: tuple[int, int], samples: Callable[[int, int], np.ndarray], segmenter: Segmenter, recognise: Callable[[np.ndarray], str | None], lost: str = "[lost]", missed: str = "[not recognised]") -> list[tuple[int, int, str]]:
    """(start, end, text) for a gap of a stream. What the ring no longer holds is one placeholder; the rest is cut anew
    and recognised, and if one part fails, the whole gap is one placeholder."""
    start, end = gap
    out = [(start, min(ring_from, end), lost)] if start < ring_from else []
    base = max(start, ring_from)
    if base >= end:
        return out
    x = samples(base, end)
    segmenter.accept(x)
    segmenter.flush()
    for s, e in segmenter.take_finished():
        text = recognise(x[s:e])
        if text is None:
            return [(start, end, missed)]
        if text.strip():
            out.append((base + s, base + e, text))
    return out


class Reconnect:
    """When a stream is opened again after it broke: after a pause that doubles up to a cap, and begins anew once a stream has
    lived long enough. One that was closed for being idle is opened as soon as there is sound."""

    def __init__(self, base: int = 1_000, cap: int = 30_000, stable: int = 60_000):
        self.base, self.cap, self.stable = base, cap, stable
        self.pause, self.opened, self.retry_at, self.idle = base, None, 0, False

    def connected(self, now: int) -> None:
        self.opened, self.idle = now, False

    def broken(self, now: int) -> int:
        """The time of the next attempt."""
        lived = 0 if self.opened is None else now - self.opened
        wait = self.base if lived >= self.stable else self.pause
        self.pause = min(wait * 2, self.cap)
        self.opened, self.retry_at = None, now + wait
        return self.retry_at

    def closed_idle(self) -> None:
        self.opened, self.idle = None, True

    def due(self, now: int, sound: bool = True) -> bool:
        return self.opened is None and sound and (self.idle or now >= self.retry_at)


class MixedQueue:
    """Chunks on their way to the mixed track: a full queue, or sources more than a window apart, gives the track up for good,
    so that what records the sources never waits."""

    def __init__(self, most: int = 256, window_ms: int = 30_000):
        self.most, self.window, self.chunks, self.ends, self.abandoned = most, window_ms, [], {}, False

    def offer(self, source: str, start_ms: int, end_ms: int, chunk) -> bool:
        if not self.abandoned:
            ends = self.ends | {source: end_ms}
            if len(self.chunks) >= self.most or max(ends.values()) - min(ends.values()) > self.window:
                self.abandoned = True
                self.chunks.clear()
            else:
                self.ends = ends
                self.chunks.append((source, start_ms, chunk))
        return not self.abandoned

    def take(self) -> list:
        out, self.chunks = self.chunks, []
        return out


def abandoned_at(chunks: DataFrame, window_ms: int = 30_000) -> DataFrame:
    """(key, at): the first chunk's seq at which a recording's sources were more than a window apart. chunks: key, seq, source, end_ms."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("seq")
    sources = ("mic", "system")
    ends: list[Column] = [F.max(F.when(F.col("source") == s, F.col("end_ms"))).over(w) for s in sources]
    apart = F.abs(ends[0] - ends[1]) > window_ms
    return chunks.withColumn("_apart", apart).where("_apart").groupBy("key").agg(F.min("seq").alias("at"))
