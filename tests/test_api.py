import json

from talkgrid import api


def test_tools_and_command_line(spark, tmp_path, capsys):
    for n, at in (("n1", "2026-01-01T10:00:00"), ("n2", "2026-02-01T10:00:00")):
        d = tmp_path / n
        d.mkdir()
        (d / "meta.json").write_text(json.dumps({"id": n, "title": n.upper(), "started_at": at, "state": "complete"}))
        (d / "segments.jsonl").write_text("\n".join(json.dumps({"seq": i, "source": "mic", "text": t, "start_ms": i * 1000, "end_ms": i * 1000 + 900, "speaker": "S1"}) for i, t in enumerate(["Good morning", "the plan", "thanks"])))
        (d / "segment-suppressions.jsonl").write_text('{"seq":2,"reason":"x"}')
        (d / "speakers.json").write_text('{"S1":{"name":"Ann"}}')
    store = api.Store(spark, str(tmp_path))
    assert [r["id"] for r in store.list_notes()] == ["n2", "n1"] and store.list_notes("2026-01-15")[0]["total"] == 1
    hit = store.search_notes("PLAN")
    assert [(h["note_id"], h["before"], h["after"]) for h in hit] == [("n1", "Good morning", ""), ("n2", "Good morning", "")]
    assert len(store.get_note("n1")["segments"]) == 2 and store.get_paragraphs("n1")[0]["text"] == "Good morning the plan"
    assert store.export_note("n1") == "[00:00:00] S1: Good morning\n[00:00:01] S1: the plan\n"
    assert store.list_speakers()[0]["name"] == "Ann"
    assert api.main(["--root", str(tmp_path), "--json", "search", "plan"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 2


def test_tools_that_write_back(spark, tmp_path):
    import pytest

    d = tmp_path / "n1"
    d.mkdir()
    doc = {"revision": 3, "paragraphs": [{"text": "Ann builds Atlas with Bo.", "source_seqs": [0, 1], "speaker": "S1", "mentions": [{"id": "x"}, {"id": "y"}]}, {"text": "Bo left.", "source_seqs": [2]}], "graph_support_mentions": ["x"], "stages": {"text": "done"}}
    (d / "aing.json").write_text(json.dumps(doc))
    (d / "identify.json").write_text('{"revision":3,"clusters":[]}')
    store = api.Store(spark, f"file://{tmp_path}")
    context = store.get_aing_context("n1")
    assert [m["id"] for m in context["paragraphs"][0]["mentions"]] == ["y"] and context["contract_version"] == api.CONTRACT and len(context["source_hash"]) == 64
    assert not store.identify_speakers("n1")["stale"]
    for bad in ([{"index": 2, "text": "a"}], [{"index": 0, "text": " "}], [{"index": 0, "text": "a"}, {"index": 0, "text": "b"}]):
        with pytest.raises(ValueError):
            store.apply_refined_texts("n1", bad)
    assert json.loads((d / "aing.json").read_text()) == doc
    got = store.apply_refined_texts("n1", [{"index": 1, "text": "Bo left Atlas."}], "m")
    assert got["updated"] == 1 and got["revision"] == 4 and got["source_hash"] != context["source_hash"] and store.identify_speakers("n1")["stale"]
    entities = [{"kind": "person", "name": "Ann"}, {"kind": "person", "name": "Bo", "aliases": ["Bob"]}, {"kind": "project", "name": "Atlas"}]
    relation = {"subject": "ann", "object": "Atlas", "predicate": "responsible_for", "confidence": 0.9, "evidence": [{"paragraph": 0, "quote": "Ann builds Atlas"}]}
    for change in ({"predicate": "likes"}, {"object": "Nobody"}, {"evidence": []}, {"evidence": [{"paragraph": 1, "quote": "Ann"}]}, {"confidence": 2.0}):
        with pytest.raises(ValueError):
            store.apply_aing_graph("n1", entities, [relation | change], api.CONTRACT, "m")
    with pytest.raises(ValueError, match="contract"):
        store.apply_aing_graph("n1", entities, [relation], 1, "m")
    made = store.apply_aing_graph("n1", entities, [relation], api.CONTRACT, "m")
    assert (made["entities"], made["relations"], made["mentions"]) == (3, 1, 5)
    now = json.loads((d / "aing.json").read_text())
    assert now["evidence"][0]["quote"] == "Ann builds Atlas" and len(now["evidence"][0]["mentions"]) == 2 and now["stages"]["relations"] == "done"
    assert store.recording_status() == {"state": "not_running"} and api.Store(spark, "x", lambda op, a: {"op": op} | a).get_live_transcript(9) == {"op": "live", "tail": 9}
    for note in ("../n1", "", "none"):
        with pytest.raises((ValueError, FileNotFoundError)):
            store.get_aing_context(note)
