"""Ledger operations against plain replays, and the canonical build on a small store."""

import datetime
import json
import random

import pytest

from talkgrid.operators import canonical as C
from talkgrid.operators import governance as G

OPS = "op_index long, id string, kind string, target string, payload string"
ENT = "id string, kind string, name string, aliases array<string>"
NOW = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)


def ledger(*ops):
    out = []
    for kind, payload, *target in ops:
        out = G.append(out, kind, payload, NOW, *target)
    return out


def frame(spark, ops):
    return spark.createDataFrame([(i, o["id"], o["kind"], o["target"], o["payload"]) for i, o in enumerate(ops)], OPS)


def test_times_only_rise():
    ops = ledger(*[("rename", {"entity": "e", "name": str(i)}) for i in range(5)])
    times = [o["at"] for o in ops]
    assert times == sorted(set(times)) and times[1] == "2026-01-01T00:00:00.000000001Z"
    assert G.next_operation_time("2026-01-01T00:00:00.999999999Z", NOW) == "2026-01-01T00:00:01.000000000Z"
    assert len({o["id"] for o in ops}) == 5
    for kind, payload in (("rename", {"entity": "e", "name": " "}), ("paint", {}), ("undo", {})):
        with pytest.raises(ValueError):
            G.append(ops, kind, payload, NOW)
    with pytest.raises(ValueError, match="no operation"):
        G.append(ops, "undo", {}, NOW, "op_none")


def test_registry_after_operations(spark):
    base = [("a", "person", "Ann", ["A"]), ("b", "person", "Bo", []), ("c", "org", "Corp", ["C1", "C2"])]
    ops = ledger(("rename", {"entity": "a", "name": "Anna"}), ("rename", {"entity": "a", "name": "Annie"}), ("add_alias", {"entity": "a", "alias": "An"}), ("remove_alias", {"entity": "c", "alias": "c1"}), ("merge", {"source": "b", "target": "a"}), ("create_entity", {"kind": "project", "name": "Atlas"}), ("add_alias", {"entity": "c", "alias": "C3"}))
    ops = G.append(ops, "undo", {}, NOW, ops[1]["id"])
    ops = G.append(ops, "undo", {}, NOW, ops[6]["id"])
    b, o = spark.createDataFrame(base, ENT), frame(spark, ops)
    rows = {r.name: (r.kind, r.aliases) for r in G.entities_after(b, o).collect()}
    assert rows == {"Anna": ("person", ["A", "An"]), "Corp": ("org", ["C2"]), "Atlas": ("project", [])}
    stored = G.entities_after(b, o)
    assert G.baseline_faults(b, o, stored).count() == 0
    other = stored.where("name <> 'Corp'").unionByName(spark.createDataFrame([("x", "org", "X", [])], ENT))
    assert sorted(r.fault for r in G.baseline_faults(b, o, other).collect()) == ["extra", "missing"]


def test_relations_after_operations(spark):
    schema = "id string, subject_id string, predicate string, label string, object_id string, confidence double, origin string, valid_from string, valid_to string"
    base = [(f"r{i}", "a", "uses", None, "b", 0.7, "model", None, None) for i in range(6)]
    ops = ledger(("confirm", {"relation": "r0"}), ("suppress", {"relation": "r1"}), ("suppress", {"relation": "r2"}), ("restore", {"relation": "r2"}), ("end", {"relation": "r3", "at": "2026-02-01T00:00:00Z"}), ("edit", {"relation": "r4", "predicate": "depends_on", "valid_from": "2026-01-01T00:00:00Z"}), ("end", {"relation": "r5", "at": "2026-02-01T00:00:00Z"}), ("restore", {"relation": "r5"}), ("create_relation", {"subject": "a", "predicate": "custom", "label": "likes", "object": "c"}))
    got = {r.id: r for r in G.relations_after(spark.createDataFrame(base, schema), frame(spark, ops)).collect()}
    assert sorted(k for k in got if k.startswith("r") and len(k) == 2) == ["r0", "r2", "r3", "r4", "r5"] and len(got) == 6
    assert got["r0"].origin == "confirmed" and got["r3"].valid_to == "2026-02-01T00:00:00Z" and got["r5"].valid_to is None
    assert (got["r4"].predicate, got["r4"].origin, got["r4"].valid_from) == ("depends_on", "manual", "2026-01-01T00:00:00Z")
    made = next(r for r in got.values() if r.origin == "user_assertion")
    assert (made.subject_id, made.label, made.object_id, made.confidence) == ("a", "likes", "c", 1.0)


def test_faults_of_operations(spark):
    rows = [("rename", {"entity": "a", "name": "x"}), ("rename", {"entity": "nobody", "name": "x"}), ("merge", {"source": "a", "target": "a"}), ("create_relation", {"subject": "a", "predicate": "likes", "object": "b"}), ("create_relation", {"subject": "a", "predicate": "custom", "object": "b"}), ("end", {"relation": "r", "at": "soon"}), ("confirm", {"relation": "none"}), ("create_entity", {"kind": "k", "name": "New"})]
    ops = [{"id": f"o{i}", "kind": k, "target": None, "payload": json.dumps(p)} for i, (k, p) in enumerate(rows)]
    made = frame(spark, ops).where("op_index = 7").select(G.entity_id(*[__import__("pyspark").sql.functions.lit(x) for x in ("k", "New")]).alias("i")).first().i
    ops += [{"id": "o8", "kind": "rename", "target": None, "payload": json.dumps({"entity": made, "name": "Newer"})}]
    got = {}
    for r in G.faults(frame(spark, ops), spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("r",)], "id string")).collect():
        got.setdefault(r.op_index, set()).add(r.fault)
    assert got == {1: {"unknown entity nobody"}, 2: {"merge into itself"}, 3: {"unknown predicate"}, 4: {"custom predicate without label"}, 5: {"not a time"}, 6: {"unknown relation none"}}


def test_older_index_becomes_a_ledger(spark):
    r = random.Random(1)
    e = [(f"e{i:03d}", "term", f"N{i}") for i in range(50)]
    ops = G.bootstrap(spark.createDataFrame(r.sample(e, 50), "id string, kind string, name string").repartition(5), spark.createDataFrame([("e004", "Four")], "id string, name string"), spark.createDataFrame([("e001", "e002")], "old_id string, new_id string")).orderBy("op_index").collect()
    assert [o.op_index for o in ops] == list(range(52)) and [json.loads(o.payload)["name"] for o in ops[:50]] == [n for *_, n in e]
    assert [o.kind for o in ops[50:]] == ["rename", "merge"] and json.loads(ops[51].payload) == {"source": "e001", "target": "e002"}


def sources(spark):
    text = "Ann leads Atlas. Bo uses Atlas too."
    none = lambda schema: spark.createDataFrame([], schema)
    f = spark.createDataFrame
    ts = "valid_from timestamp, valid_to timestamp"
    return C.Sources(
        entities=f([(n, e, k, w, p) for n in (1, 2) for e, k, w, p in (("x", "person", "Ann", "P1"), ("y", "project", "Atlas", None), ("z", "person", "Bo", None), ("w", "person", "Kim", None))], "note_id long, entity string, kind string, name string, person_id string"),
        mentions=f([(n, 0, s, s + len(w), e) for n in (1, 2) for e, w in (("x", "Ann"), ("y", "Atlas"), ("z", "Bo")) for s in [text.index(w)]], "note_id long, paragraph int, start int, end int, entity string"),
        paragraphs=f([(1, 0, text), (2, 0, "Well. " + text)], "note_id long, paragraph int, text string"),
        evidence=f([(f"{n}{k}", n, 0, s, e, q) for n in (1, 2) for k, s, e, q in (("a", 0, 16, "Ann leads Atlas."), ("b", 17, 35, "Bo uses Atlas too."), ("c", 0, 4, "gone"))], "evidence_id string, note_id long, paragraph int, start int, end int, quote string"),
        relations=f([(n, s, o, p, None, c, None, None, f"{n}{ev}") for n in (1, 2) for s, o, p, c, ev in (("x", "y", "responsible_for", 0.9, "a"), ("z", "y", "uses", 0.6 + n / 10, "b"), ("x", "z", "uses", 0.9, "c"), ("y", "y", "uses", 0.9, "a"))], f"note_id long, subject string, object string, predicate string, label string, confidence double, {ts}, evidence_id string"),
        registry=f([("kg_atlas", "project", "Atlas", ["A"]), ("kg_old", "person", "Bob", []), ("kg_bo", "person", "Bo", []), ("kg_k1", "person", "Kim", []), ("kg_k2", "person", "Kimberly", ["kim"])], ENT),
        people=f([("P1", "Ann Lee"), ("P2", "Unused")], "id string, name string"),
        bindings=none("note_id long, entity string, target string"), redirects=f([("kg_old", "kg_bo")], "old_id string, new_id string"),
        events=none("op_index long, relation_id string, kind string, value timestamp"),
        assertions=f([("kg_bo", "belongs_to", "P2", 1.0, None, None), ("kg_bo", "belongs_to", "kg_nowhere", 1.0, None, None)], f"subject_id string, predicate string, object_id string, confidence double, {ts}"),
    )


def test_canonical_build(spark):
    s = sources(spark)
    g = C.build(s)
    rel = {(r.subject_id, r.predicate, r.object_id): r for r in g.relations.collect()}
    assert {k: r.tier for k, r in rel.items()} == {("P1", "responsible_for", "kg_atlas"): "published", ("kg_bo", "uses", "kg_atlas"): "published", ("kg_bo", "belongs_to", "P2"): "published"}
    bo = rel["kg_bo", "uses", "kg_atlas"]
    assert (round(bo.confidence, 3), bo.evidence_count, bo.note_count) == (0.8, 2, 2)
    assert {(r.kind, r.reason) for r in g.pending.collect()} == {("identity", "kg_k1,kg_k2"), ("relation", "self_loop"), ("relation", "missing_endpoint")}
    assert {r.id for r in g.entities.collect()} == {"P1", "P2", "kg_atlas", "kg_bo"} and g.additions.count() == 0
    assert {r.evidence_id: (r.status, r.start) for r in g.evidence.collect()} == {"1a": ("exact", 0), "1b": ("exact", 17), "2a": ("moved", 6), "2b": ("moved", 23)}
    events = spark.createDataFrame([(0, bo.id, "suppress", None)], "op_index long, relation_id string, kind string, value timestamp")
    s.events = events
    assert ("kg_bo", "uses", "kg_atlas") not in {(r.subject_id, r.predicate, r.object_id) for r in C.build(s).relations.collect()}


def test_terminals_aliases_and_mentions(spark):
    f = spark.createDataFrame
    redirects = f([("a", "b"), ("c", "d")], "old_id string, new_id string")
    got = {r.key: (r.target, r.candidates) for r in C.single_terminal(f([("k", "a"), ("k", "b"), ("l", "a"), ("l", "c")], "key string, id string"), redirects).collect()}
    assert got == {"k": ("b", None), "l": (None, ["b", "d"])}
    rel = f([("r", "x", "uses", "y")], "id string, subject_id string, predicate string, object_id string")
    lineage = f([("x", "a"), ("y", "y")], "id string, root string")
    assert C.relation_aliases(rel, lineage, redirects).count() == 3  # x, a and b, each with y
    ev = f([("e", 1, 0, 0, 10)], "evidence_id string, note_id long, paragraph int, start int, end int")
    me = f([("m1", 1, 0, 0, 3, "b"), ("m2", 1, 0, 4, 10, "y"), ("m3", 1, 0, 8, 12, "b")], "mention_id string, note_id long, paragraph int, start int, end int, entity_id string")
    r = C.evidence_mentions(ev, me, f([("r", "e", "b", "y")], "relation_id string, evidence_id string, subject_id string, object_id string")).first()
    assert (r.subject_mentions, r.object_mentions) == (["m1"], ["m2"])
    docs = f([(1, "x", "person", "Ann", 2), (2, "x", "org", "ann ", 1), (2, "y", "org", " ", 1)], "note_id long, entity string, kind string, name string, mention_count long")
    entities, ne = C.rebuild_older(docs, f([("P1", "Ann", [])], "id string, name string, aliases array<string>"))
    assert sorted((r.id, r.kind) for r in entities.collect()) == [("P1", "person"), ("e:ann", "org")] and ne.count() == 2
