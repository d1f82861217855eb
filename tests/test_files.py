import json

import pytest

from talkgrid.sources import files as S


@pytest.fixture()
def store(tmp_path):
    for n, meta in (("n1", {"id": "n1", "title": "One", "started_at": "2026-01-01T10:00:00", "state": "complete"}), ("n2", None)):
        d = tmp_path / n
        d.mkdir()
        (d / "meta.json").write_text(json.dumps(meta) if meta else "{broken")
        (d / "segments.jsonl").write_text('{"seq":0,"source":"mic","text":"a","start_ms":0,"end_ms":900}\n\n{bad\n{"seq":1,"source":"system","text":"b","start_ms":950,"end_ms":1200}\n')
        (d / "segment-suppressions.jsonl").write_text('{"seq":1,"reason":"echo"}\n???\n')
        (d / "speakers.json").write_text('{"S1":{"name":"Ann","sources":["mic"],"count":2}}' if n == "n1" else "nope")
        (d / "mix.m4a").write_bytes(b"x" * 100)
        (d / "refined.json").write_text('{"old":1}')
    (tmp_path / "n1" / "aing.json").write_text('{"new":1}')
    return str(tmp_path)


def test_scans(spark, store):
    meta = {r.id: r for r in S.scan_meta(spark, store).collect()}
    assert meta["n1"].title == "One" and not meta["n1"].fallback and meta["n2"].fallback and meta["n2"].started_at == "" and meta["n2"].state == "complete"
    assert S.scan_segments(spark, store).count() == 4
    assert {r.note_id: r.skipped_lines for r in S.skipped_lines(spark, store).collect()} == {"n1": 1, "n2": 1}
    assert sorted(map(tuple, S.scan_suppressions(spark, store).collect())) == [("n1", 1), ("n2", 1)]
    assert [(r.note_id, r.speaker_id, r.name) for r in S.scan_speakers(spark, store).collect()] == [("n1", "S1", "Ann")]
    assert {r.note_id: r.doc for r in S.scan_documents(spark, store).collect()} == {"n1": '{"new":1}', "n2": '{"old":1}'}
    assert {r.note_id: r.bytes for r in S.folder_bytes(spark, store).collect()} == {"n1": 100, "n2": 100}
    raw = S.scan_lines(spark, f"{store}/*/segments.jsonl", S.SEGMENT)
    assert raw.where("not ok").first().raw == "{bad"


def test_ledger_log_and_drift(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"operations": [{"id": "a", "at": "t", "kind": "rename", "payload": "{}"}, {"id": "b", "at": "t", "kind": "undo", "payload": '{"target":"a"}'}]}))
    assert [(r.op_index, r.id, r.kind) for r in S.scan_ledger(spark, str(tmp_path / "l.json")).collect()] == [(0, "a", "rename"), (1, "b", "undo")]
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception):
        S.scan_ledger(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "log").mkdir()
    for i in range(3):
        (tmp_path / "log" / f"{i}.json").write_text(json.dumps({"id": str(i), "ts": f"2026-01-0{i + 1}", "kind": "title"}) if i < 2 else "{")
    assert [r.id for r in S.scan_log(spark, str(tmp_path / "log")).collect()] == ["1", "0"]
    (tmp_path / "drift.json").write_text('{"schema":1,"history":[{"schema":0},{"schema":2}]}')
    assert S.scan_drift(spark, str(tmp_path / "drift.json")).count() == 3


def test_export(spark, tmp_path):
    assert S.export_lines(spark.range(7), str(tmp_path / "out")) == 7


def test_people_and_documents(spark, tmp_path):
    (tmp_path / "people.json").write_text('{"people":{"P1":{"name":"Ann","aliases":["A"]},"P2":{"name":"Bo"}}}')
    assert sorted((r.id, r.name) for r in S.scan_people(spark, str(tmp_path / "people.json")).collect()) == [("P1", "Ann"), ("P2", "Bo")]
    (tmp_path / "broken.json").write_text("{")
    assert S.scan_people(spark, str(tmp_path / "broken.json")).count() == 0
    docs = spark.createDataFrame([("a", '{"v":1}'), ("b", "[1]"), ("c", "x"), ("d", None)], "note_id string, doc string")
    good, bad = S.parse_documents(docs, "v int")
    assert [tuple(r) for r in good.collect()] == [("a", 1)] and sorted(r.note_id for r in bad.collect()) == ["b", "c", "d"]
