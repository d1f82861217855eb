"""Stateful audio operators against plain versions, and whole runs."""

import json

import numpy as np
import pandas as pd
import pytest

from talkgrid.operators import audio as A
from talkgrid.operators import pipelines as P


@pytest.mark.parametrize(("source", "target"), [(48_000, 16_000), (44_100, 16_000), (16_000, 48_000), (8_000, 8_000)])
def test_a_stream_resamples_as_a_whole(source, target):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4_000)
    whole = A.Resampler(source, target).push(x)
    r, parts, at = A.Resampler(source, target), [], 0
    while at < len(x):
        n = int(rng.integers(0, 400))
        parts.append(r.push(x[at : at + n]))
        at += n
    got = np.concatenate(parts)
    # A piece's last samples may lean on the one before where the next has not come: compare where both neighbours were there.
    assert len(got) == len(whole) == len(x) * target // source
    want = np.interp(np.arange(len(whole)) * source / target, np.arange(len(x)), x)
    assert np.allclose(whole, want) and np.mean(np.isclose(got, want)) > 0.95


def test_segments_close_on_silence(spark):
    sound = lambda n: np.full(n * 160, 0.5)
    quiet = lambda n: np.zeros(n * 160)
    x = np.concatenate([quiet(20), sound(50), quiet(40), sound(5), quiet(60), sound(30), quiet(10), sound(30)])
    s = A.Segmenter()
    for part in np.array_split(x, 37):
        s.accept(part)
    s.flush()
    assert [(a // 160, b // 160) for a, b in s.take_finished()] == [(15, 75), (170, 245)]
    long = A.Segmenter(most=100)
    long.accept(sound(250))
    long.flush()
    got = long.take_finished()
    assert [(a // 160, b // 160) for a, b in got] == [(0, 100), (100, 200), (200, 250)]
    rows = [("mic", i, np.repeat(f, 2).tolist()) for i, f in enumerate(np.array_split(np.repeat(x, 3), 50))]
    out = A.segments_of(spark.createDataFrame(rows, "source string, seq int, samples array<double>"), 2, 48_000, 16_000).orderBy("start").collect()
    assert [(round(r.start / 160), round(r.end / 160)) for r in out] == [(15, 75), (170, 245)]
    kinds = [k for k, *_ in A.segment_worker(iter(np.array_split(x, 37)), 1, 16_000, 16_000, A.Segmenter(), 1600)]
    assert kinds.count("final") == 2 and kinds.count("partial") >= 4


def test_alignment_is_found_and_refined():
    rng = np.random.default_rng(2)
    signal = rng.normal(size=3_000)
    place, score, second = A.best_place(signal[1_200:1_500], signal, 1_000, 1_400)
    assert place == 1_200 and score == pytest.approx(1) and second < 0.5
    smooth = np.convolve(rng.normal(size=4_000), np.ones(9) / 9, "same")
    window = np.interp(np.arange(400) * 1.005 + 1_000, np.arange(4_000), smooth)
    assert A.scan_slopes(window, smooth, 1_000, 20)[3] == 1.005
    line = lambda t: 1.01 * t + 3
    knots = [(0.0, line(0)), (400.0, line(400)), (430.0, line(430))]
    got = A.refine_gaps(knots, lambda t, y, m: (t, line(t)), 1_000, (0.95, 1.05))
    assert max(b[0] - a[0] for a, b in zip(got, got[1:], strict=False)) <= 60 and len(got) == 3 + 7
    assert A.refine_gaps(knots, lambda t, y, m: (t, y + 50), 1_000, (0.95, 1.05)) == knots
    assert A.refine_gaps(knots, lambda t, y, m: None, 1_000, (0.95, 1.05)) == knots
    assert A.within_slopes([(0, 0), (10, 10), (20, 60), (30, 30.2)], (0.9, 1.1)) == [(0, 0), (10, 10), (30, 30.2)]


def test_echo_delay_and_residual():
    rng = np.random.default_rng(3)
    ref = rng.normal(size=5_000)
    mic = np.concatenate([np.zeros(137), 0.4 * ref])[:5_000] + 0.05 * rng.normal(size=5_000)
    d = A.EchoDelay(800, 300)
    for a, b in zip(np.array_split(ref, 9), np.array_split(mic, 9), strict=True):
        d.push(a, b)
    assert d.delay() == 137 and len(d.lags) >= 3
    noise = A.EchoDelay(800, 300)
    noise.push(ref, rng.normal(size=5_000))
    assert noise.delay() is None
    assert A.residual_peak(ref, mic) > 0.9 and A.residual_peak(ref, rng.normal(size=5_000)) < 0.2 and A.residual_peak(ref, np.zeros(5_000)) is None


def test_mixed_tracks(spark):
    rows = [(1, "mixed", 0, 10_000, None, "live"), (1, "mic", 0, 9_800, None, None), (1, "system", 100, None, 9_900, None), (2, "mixed", 0, 10_000, None, "live"), (2, "mic", 0, 12_000, None, None), (3, "mixed", 0, 10_000, None, "regen"), (3, "mic", 0, 11_500, None, None), (4, "mic", 0, 1, None, None), (5, "mixed", 0, None, None, None), (5, "mic", 0, 1, None, None), (6, "mixed", 0, 5, None, None), (6, "mic", 0, None, None, None), (7, "mixed", 0, 5, None, None)]
    got = {r.note_id: r.reason for r in A.mixed_untrusted(spark.createDataFrame(rows, "note_id int, track string, offset_ms long, duration_ms long, sync_ms long, origin string")).collect()}
    assert got[1] is None and got[2] == "ends at 10000 ms, the sources at 12000" and got[3] is None and got[4] == "no mixed track"
    assert got[5] == "the mixed track's length is not known" and got[6] == "a source's length is not known" and got[7] == "no source to compare with"


def test_gaps_reconnections_and_queues(spark):
    x = np.concatenate([np.zeros(3_200), np.full(16_000, 0.5), np.zeros(16_000), np.full(16_000, 0.5), np.zeros(8_000)])
    cut = lambda a, b: x[a:b]
    got = A.backfill_gap(1_600, (0, len(x)), cut, A.Segmenter(), lambda s: f"{len(s) > 9_000}")
    assert got[0] == (0, 1_600, "[lost]") and [t for *_, t in got[1:]] == ["True", "True"]
    assert A.backfill_gap(0, (0, len(x)), cut, A.Segmenter(), lambda s: None) == [(0, len(x), "[not recognised]")]
    r = A.Reconnect()
    waits, now = [], 0
    for lived in (0, 10, 10, 10, 10, 10, 10, 70_000, 10):
        r.connected(now)
        at = r.broken(now + lived)
        waits.append(at - now - lived)
        assert not r.due(at - 1) and r.due(at)
        now = at
    assert waits == [1_000, 2_000, 4_000, 8_000, 16_000, 30_000, 30_000, 1_000, 2_000]
    r.connected(now)
    r.closed_idle()
    assert r.due(now, sound=True) and not r.due(now, sound=False)
    q = A.MixedQueue(most=3)
    assert q.offer("mic", 0, 1_000, b"") and q.offer("system", 0, 900, b"") and len(q.take()) == 2
    assert not q.offer("mic", 1_000, 40_000, b"") and q.abandoned and not q.offer("system", 0, 41_000, b"")
    rows = [(1, 0, "mic", 1_000), (1, 1, "system", 1_000), (1, 2, "mic", 32_500), (2, 0, "mic", 90_000)]
    assert [tuple(x) for x in A.abandoned_at(spark.createDataFrame(rows, "key int, seq int, source string, end_ms long")).collect()] == [(1, 2)]


def test_models_are_applied_by_partition(spark):
    clips = spark.createDataFrame([("a", "mic", i, [float(i + 1), 2.0]) for i in range(6)] + [("b", "mic", 9, [])], "person_id string, source string, clip int, samples array<double>")
    make = lambda: lambda x: x if len(x) else None
    lib = {r.person_id: r for r in P.rebuild_library(clips, make, "m2").collect()}
    unit = np.asarray([[i + 1, 2.0] for i in range(6)])
    assert np.allclose(lib["a"].vector, (unit / np.linalg.norm(unit, axis=1, keepdims=True)).mean(0)) and lib["a"].samples == 6 and lib["a"].model == "m2" and "b" not in lib
    assert {r.text for r in P.recognised(clips, lambda: lambda x: (str(len(x)), "en")).collect()} == {"2", "0"}


def test_refining_and_transcribing_again(spark):
    seg = "note_id long, seq long, speaker string, text string, start_ms long, end_ms long, lang string"
    rows = [(1, 0, "S1", "Hello there my friends", 0, 2_000, "en"), (1, 1, "S1", "how are you all", 2_100, 4_000, "en"), (1, 2, "S2", "...", 4_100, 4_200, "en"), (1, 3, "S2", "very well thank you", 5_000, 7_000, "en")]
    kept, stats, paragraphs = P.refine(spark.createDataFrame(rows, seg))
    assert sorted(r.seq for r in kept.collect()) == [0, 1, 3] and {r.speaker: r.segments for r in stats.collect()} == {"S1": 2, "S2": 1} and paragraphs.count() == 2
    new = [(1, 0, "mic", "very well thank you", 5_050, 7_000, "en"), (1, 1, "system", "very well thank you", 5_000, 7_000, "en"), (1, 2, "mic", "Hello there my dear friends", 0, 2_100, "en"), (1, 3, "mic", "covered by the gate", 9_000, 10_000, "en")]
    schema = "note_id long, seq long, source string, text string, start_ms long, end_ms long, lang string"
    old = [(1, s, "mic" if sp == "S1" else "system", t, a, b, lang, sp) for _, s, sp, t, a, b, lang in rows]
    out, verdicts = P.transcribed_again(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema + ", speaker string"), spark.createDataFrame([(1, 8_900, 10_100)], "note_id long, start_ms long, end_ms long"))
    assert [(r.seq, r.source, r.speaker) for r in out.orderBy("seq").collect()] == [(0, "mic", "S1"), (1, "system", "S2")]
    assert [r.verdict for r in verdicts.collect()] == ["commit"]


def test_blocks_people_and_hooks(spark):
    got = P.blocks([{"text": "Ann met Bo", "mentions": [{"id": "a", "start": 0, "end": 3}, {"id": "b", "start": 8, "end": 10}]}, {"text": "x", "mentions": [{"id": "a", "start": 0, "end": 1}]}], {"a"})
    assert got[0]["kind"] == "runs" and got[0]["runs"] == [("Ann met ", None), ("Bo", "b")] and got[1]["kind"] == "markdown" and got[1]["orig_index"] == 1
    people = spark.createDataFrame([(1, "王小明"), (2, "Ann"), (3, "李雷")], "id int, label string")
    table = spark.createDataFrame([("王", "wang"), ("小", "xiao"), ("明", "ming"), ("李", "li"), ("雷", "lei")], "char string, syllable string")
    find = lambda q, t=table: sorted(r.id for r in P.filter_people(people, q, t).collect())
    assert find("xiaom") == [1] and find("ll") == [3] and find("An") == [1, 2] and find("小") == [1] and find(" ") == [1, 2, 3] and find("wang", None) == []
    seen, h = [], P.Hooks()
    h.register(lambda e, p: seen.append((e, p)), "done")
    h.register(lambda e, p: 1 / 0)
    h.emit("done", {"a": 1})
    h.sink("done")(spark.createDataFrame(pd.DataFrame({"payload": [json.dumps({"a": 2})]})), 0)
    assert seen == [("done", {"a": 1}), ("done", {"a": 2})] and len(h.failed) == 2
