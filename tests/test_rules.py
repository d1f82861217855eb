"""Rules and people's operators beyond what the registered queries show."""

import datetime

import pytest
from pyspark.sql import functions as F

from talkgrid.functions import rules as R
from talkgrid.functions import text as T
from talkgrid.operators import graph as G
from talkgrid.operators import notes as N
from talkgrid.operators import people as P
from talkgrid.operators import windows as W


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_intervals(spark):
    a, b, none = F.lit("2026-01-01T00:00:00+01:00"), F.lit("2026-01-02T00:00:00Z"), F.lit(None).cast("string")
    got = one(spark, R.checked_interval(a, b), R.checked_interval(none, b), R.checked_interval(none, none), R.instant(F.lit("2026-01-01 00:00")), R.instant(F.lit("2026-13-01T00:00:00Z")))
    assert got[0]["from"] == datetime.datetime(2025, 12, 31, 23) and got[1]["from"] is None and got[2] == (None, None) and got[3:] == (None, None)
    for bad in ((b, a), (F.lit("soon"), b), (a, a)):
        with pytest.raises(Exception):
            one(spark, R.checked_interval(*bad))


def test_forms(spark):
    got = one(spark, R.locale(F.lit(None).cast("string")), R.locale(F.lit("en-" + "x" * 20)), R.os_version(F.lit(None).cast("string")), R.speaker_passes(F.lit(None).cast("string"), []), R.speaker_passes(F.lit(None).cast("string"), ["a"]), R.since_passes(F.lit("x"), None), R.canonical_set(F.expr("cast(array() as array<int>)")), R.canonical_set(F.array(F.lit(1), F.lit(1))))
    assert got == ("unknown", "unknown", "unknown", True, False, True, True, False)
    assert one(spark, R.first_string(F.lit('{"b":{"c":"x"}}'), "$.a", "$.b.c"), R.tolerant(F.lit(None).cast("int"), F.lit(False)), R.applying({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(True)})) == ("x", True, ["a", "c"])
    assert one(spark, R.record_risks(F.lit(True), F.lit(True))) == (["voice_isolation", "bluetooth_mic"],)
    for t, n in (("aé", 1), ("aé", 2), ("aé", 3), ("é", 1), ("", 0), ("\U0001f600", 3)):
        c = one(spark, T.cut_bytes(F.lit(t), n))[0]
        assert c["text"] == t.encode()[:n].decode("utf-8", "ignore") and c["cut"] == (len(t.encode()) > n)
    assert one(spark, T.alike(F.lit("abcd"), F.lit("abce"), 0.75), T.alike(F.lit("abcd"), F.lit("abxy"), 0.75), T.alike(F.lit(""), F.lit("a"), 0.75), T.alike(F.lit("abcd"), F.lit("xxabcdxxxxxx"), 0.9)) == (True, False, False, True)


def test_titles_pass_over_taken_numbers(spark):
    at = datetime.datetime(2026, 1, 6, 19)  # a Tuesday evening
    notes = spark.createDataFrame([(i, at) for i in range(4)] + [(9, at + datetime.timedelta(days=1))], "id int, at timestamp")
    taken = spark.createDataFrame([("20260106", "周二晚上的会议"), ("20260106", "周二晚上的会议 3"), ("20260106", "周二晚上的会议 x"), ("20260107", "周二晚上的会议")], "day string, title string")
    got = {r.id: r.title for r in N.numbered_titles(notes, taken).collect()}
    assert got == {0: "周二晚上的会议 2", 1: "周二晚上的会议 4", 2: "周二晚上的会议 5", 3: "周二晚上的会议 6", 9: "周三晚上的会议"}


def test_merging_speakers(spark):
    s = spark.createDataFrame([(1, "S1", " ", None, ["mic"], 2), (1, "S2", "Ann", "P1", ["system"], 3), (1, "S3", "Bo", "P2", ["mic"], 1), (2, "S2", "Kim", None, ["mic"], 1)], "note_id int, speaker_id string, name string, person_id string, sources array<string>, count long")
    m = spark.createDataFrame([(1, "S2", "S1"), (1, "S3", "S1")], "note_id int, loser string, winner string")
    got = {(r.note_id, r.speaker_id): (r.name, r.person_id, r.sources, r["count"]) for r in P.merge_speakers(s, m).collect()}
    assert got == {(1, "S1"): ("Ann", "P1", ["mic", "system"], 6), (2, "S2"): ("Kim", None, ["mic"], 1)}
    seg = spark.createDataFrame([(1, 0, "S9"), (1, 1, "S1"), (1, 2, None), (1, 3, "S8")], "note_id int, seq int, speaker string")
    out, add = P.repair_orphans(seg, spark.createDataFrame([(1, "S1")], "note_id int, speaker_id string"), spark.createDataFrame([(1, "S9", "S7"), (1, "S7", "S1")], "note_id int, loser string, winner string"))
    assert sorted((r.seq, r.speaker, r.repaired) for r in out.collect()) == [(0, "S1", True), (1, "S1", False), (2, None, False), (3, "S8", True)] and [tuple(r) for r in add.collect()] == [(1, "S8")]


def test_pending_filters_and_logs(spark):
    rows = [("merge", 2, '{"kind":"person"}'), ("merge", 1, '{"subject":{"kind":"org"}}'), ("relation", 3, '{"relation":{"valid_to":"2020-01-01T00:00:00Z"}}'), ("relation", 4, "{}")]
    p = spark.createDataFrame(rows, "kind string, id int, payload string")
    assert [r.id for r in G.pending_review(p, kinds=["person"]).collect()] == [2, 3, 4]
    assert [r.id for r in G.pending_review(p, low="2021-01-01T00:00:00Z").collect()] == [1, 2, 4]
    assert [r.kind for r in G.pending_groups(p.withColumn("kind", F.lit("zeta")).unionByName(p)).collect()] == ["merge", "relation", "zeta"]
    log = spark.createDataFrame([(i, f"2026-01-{i:02d}", "a" if i % 2 else "b", i % 3) for i in range(1, 20)], "id int, ts string, kind string, note_id int")
    assert [r.id for r in N.log_entries(log, kind="a", note_id=1, high="2026-01-15", limit=2, offset=1).collect()] == [7, 1]
    bars = W.peak_bars(spark.createDataFrame([("a", 0.01), ("a", 0.02), ("b", 4.0)], "k string, v double"), "v", key="k").collect()
    assert sorted(round(r.bar, 3) for r in bars) == [0.2, 0.4, 1.0]
