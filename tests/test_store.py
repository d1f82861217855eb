"""Writes of the store: documents, segments, versions, rebuilds and re-transcription."""

import json

import pytest

from talkgrid.sources import store as S


def test_documents_and_lines(spark, tmp_path):
    f, path = S.Files(spark), f"file://{tmp_path}/a.json"
    assert f.read(path) is None and f.read_json(path, 5) == 5
    f.write_json(path, {"é": 1})
    f.write_json(path, {"é": 2})
    assert f.read_json(path) == {"é": 2} and [p.name for p in tmp_path.iterdir() if p.suffix == ".tmp"] == []
    lines = '{"a": 1,  "b":2}\nbroken\n{"a":2}\n{"a":3}\n'
    f.write(f"file://{tmp_path}/l.jsonl", lines)
    changed = f.rewrite_lines(f"file://{tmp_path}/l.jsonl", lambda r: None if r["a"] == 3 else r | {"a": 9} if r["a"] == 2 else r)
    assert changed == 2 and (tmp_path / "l.jsonl").read_text() == '{"a": 1,  "b":2}\nbroken\n{"a": 9}\n'
    S.set_waveform(f, f"file://{tmp_path}", "mic", [1, 2])
    S.set_waveform(f, f"file://{tmp_path}", "system", [3])
    assert f.read_json(f"file://{tmp_path}/meta.json")["audio"]["tracks"] == {"mic": {"waveform": [1, 2]}, "system": {"waveform": [3]}}


def test_segments_wait_in_order():
    out, broken = [], [True]

    def write(lines):
        if broken[0]:
            raise OSError("disk")
        out.extend(json.loads(x)["text"] for x in lines)

    a = S.SegmentAppender(write, first_seq=4)
    assert a.append("mic", "one", 0, 1) == 4 and a.append("mic", "two", 1, 2) == 5 and out == [] and len(a.waiting) == 2
    broken[0] = False
    assert a.append("mic", "three", 2, 3, "S1") == 6 and out == ["one", "two", "three"] and a.drain() == 0


def test_versions_are_checked(spark, tmp_path):
    root = f"file://{tmp_path}/graph"
    for i in range(5):
        S.publish(spark.range(i + 1), root, f"b{i}")
    assert S.published(spark, root).count() == 5
    assert sorted(p.name for p in (tmp_path / "graph").iterdir() if p.name.startswith("v=")) == ["v=b2", "v=b3", "v=b4"]
    next((tmp_path / "graph" / "v=b4").glob("*.parquet")).unlink()
    with pytest.raises(ValueError, match="damaged"):
        S.published(spark, root)
    with pytest.raises(FileNotFoundError):
        S.published(spark, f"file://{tmp_path}/none")


def test_rebuilds_take_the_last_source(spark, tmp_path):
    root, source = f"file://{tmp_path}/g", [0, 3]
    taken = []

    def snapshot():
        taken.append(source[0])
        table = spark.range(source[0] + 1)
        if source[1]:
            source[1] -= 1
            source[0] += 1  # changes while it is being built
        return str(taken[-1]), table

    r = S.Rebuilds(spark, root)
    assert [r.request() for _ in range(4)] == [1, 2, 3, 4] and r.dirty()
    assert r.run(snapshot, lambda: str(source[0])) == 1 and not r.dirty() and r.done() == 4
    assert taken == [0, 1, 2, 3] and S.published(spark, root).count() == 4 and r.run(snapshot, lambda: "") == 0
    assert r.request() == 5
    with pytest.raises(RuntimeError):
        S.rebuild(spark, root, lambda: ("a", spark.range(1)), lambda: "b", rounds=2)


def test_transcripts_are_committed(spark, tmp_path):
    f, note = S.Files(spark), f"file://{tmp_path}/n"
    (tmp_path / "n").mkdir()
    f.write(f"{note}/segments.jsonl", '{"seq":0,"speaker":"S1"}\n')
    f.write(f"{note}/segment-suppressions.jsonl", "{}")
    f.write_json(f"{note}/aing.json", {"revision": 2})
    f.write_json(f"{note}/speakers.json", {"S1": {"name": "Ann"}, "S9": {"name": "Old"}})
    for text in ("a", "b"):  # a second time leaves the first backup
        S.commit_transcript(f, note, [{"seq": 0, "speaker": "S1", "text": text}], {"S1": {"count": 1}, "S2": {"name": ""}})
    assert f.read(f"{note}/segments.orig.jsonl") == '{"seq":0,"speaker":"S1"}\n' and '"b"' in f.read(f"{note}/segments.jsonl")
    assert f.read_json(f"{note}/speakers.json") == {"S1": {"name": "Ann", "count": 1}, "S2": {"name": ""}}
    assert f.read_json(f"{note}/aing.json") == {"revision": 4, "stale": True} and not f.exists(f"{note}/segment-suppressions.jsonl")
