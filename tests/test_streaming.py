import json

from talkgrid.streaming import alarms, echo


def event(at, source, seq, start, end, text, kind="final", rms=0.1, note=1):
    return {"note_id": note, "at_ms": at, "kind": kind, "source": source, "seq": seq, "start_ms": start, "end_ms": end, "text": text, "rms": rms}


def ops(events):
    d = echo.Dedup()
    out = []
    for e in events:
        out += [(s, op, why) for s, op, why, _ in d.push(e)]
        d = echo.Dedup(json.loads(json.dumps(d.state())))
    return out


def test_echo_is_dropped_held_and_retracted():
    held = [event(1000, "mic", 1, 0, 1000, "let us start now"), event(1500, "system", 2, 0, 1200, "Let us start, now!")]
    assert ops(held) == [(2, "emit", "system"), (1, "drop", "echo")]
    late = [held[0], event(4000, "mic", 3, 3500, 4000, "other words"), event(4100, "system", 4, 200, 1100, "let us start now")]
    assert ops(late) == [(1, "emit", "released"), (4, "emit", "system"), (1, "retract", "echo")]
    known = [held[1], event(1600, "mic", 5, 100, 1100, "let us start now")]
    assert ops(known) == [(2, "emit", "system"), (5, "drop", "echo")]
    assert ops([held[1], event(1700, "mic", 6, 100, 1100, "quite different", rms=0.001)])[-1] == (6, "drop", "residue")
    assert ops([event(1500, "system", 2, 0, 1200, "我们现在开始吧"), event(1600, "mic", 7, 100, 1100, "Yeah.")])[-1] == (7, "drop", "filler")
    failed = [event(1500, "system", 2, 0, 1200, echo.PLACEHOLDER), event(1600, "mic", 8, 100, 1100, echo.PLACEHOLDER)]
    assert ops(failed) == [(2, "emit", "system")]
    assert ops([*failed, event(9000, "mic", 0, 0, 0, "", kind="end")])[-1] == (8, "emit", "released")


def test_open_partial_extends_the_hold():
    first = event(1000, "mic", 1, 0, 1000, "hello there")
    partial = event(1100, "system", 0, 0, 0, "he", kind="partial")
    assert ops([first, partial, event(4000, "mic", 2, 3900, 4000, "more")]) == []
    assert ops([first, partial, event(16_500, "mic", 2, 16_000, 16_500, "more")])[0] == (1, "emit", "released")


def test_stream_and_batch_agree(spark, tmp_path):
    rows = []
    for note in (1, 2):
        for i in range(12):
            rows.append(event(1000 * i + 900, "mic" if i % 2 else "system", i, 1000 * i, 1000 * i + 800, f"words of turn {i // 2}", note=note))
        rows.append(event(60_000, "mic", 99, 0, 0, "", kind="end", note=note))
    src = tmp_path / "in"
    src.mkdir()
    for n, part in enumerate((rows[:9], rows[9:20], rows[20:])):
        (src / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
    batch = echo.dedup_batch(spark.createDataFrame(rows, echo.IN).where("kind <> 'end'"))
    q = echo.dedup_stream(spark.readStream.schema(echo.IN).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(src))).writeStream.format("memory").queryName("ops").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in echo.settled(batch).collect()}
    assert {tuple(r) for r in echo.settled(spark.table("ops")).collect()} == want and want


def test_alarm_has_hysteresis():
    a = alarms.GapAlarm()
    edges = [(t, e) for t in range(200) if (e := a.push(float(t), 0.2 if 70 <= t < 100 else 0.0))]
    assert [e for _, e in edges] == ["fired", "recovered"]


def test_rate_filter_converges():
    f, t, ppm = alarms.RateFilter(), 0.0, 0.0
    for _ in range(20_000):
        t += 0.02 * (1 + 80e-6)
        ppm = f.push(t, 0.02)
    assert abs(ppm - 80) < 1 and f.reanchors == 0


def test_live_windows(spark, tmp_path):
    rows = [{"source": i % 3, "ts": f"2026-01-01T00:{i % 60:02d}:00.000Z", "value": 1.0} for i in range(120)]
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("source long, ts timestamp, value double").json(str(src))
    q = alarms.tumbling(stream, "10 minutes", "0 seconds").writeStream.format("memory").queryName("win").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = alarms.tumbling(spark.read.schema("source long, ts timestamp, value double").json(str(src)), "10 minutes")
    assert {tuple(r) for r in spark.table("win").collect()} >= {tuple(r) for r in want.collect()}
