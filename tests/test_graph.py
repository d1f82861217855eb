import random

from talkgrid.operators import graph as G


def brute(edges, start, end, most):
    near, best = {}, None
    for i, a, b, cost, conf in edges:
        near.setdefault(a, []).append((i, b, cost, conf))
        near.setdefault(b, []).append((i, a, cost, conf))

    def walk(node, seen, cost, weakest, ids):
        nonlocal best
        if node == end:
            key = (cost, len(ids), -weakest, ids)
            best = key if best is None or key < best else best
            return
        if len(ids) < most:
            for i, n, c, f in near.get(node, ()):
                if n not in seen:
                    walk(n, seen | {n}, cost + c, min(weakest, f), [*ids, i])

    walk(start, {start}, 0, 1.0, [])
    return best


def test_shortest_path_is_the_best_simple_path(spark):
    r = random.Random(3)
    for n, m, most in ((12, 20, 5), (30, 60, 5), (8, 5, 5), (10, 30, 4), (14, 40, 7), (40, 50, 6), (6, 30, 1)):
        edges = [(f"e{i:03d}", r.randrange(n), r.randrange(n), r.choice([1_000_000, 1_300_000, 3_000_000]), r.choice([0.5, 0.8, 1.0])) for i in range(m)]
        edges = [e for e in edges if e[1] != e[2]]
        want = brute(edges, 0, n - 1, most)
        df = spark.createDataFrame(edges, "id string, a long, b long, cost long, confidence double")
        got = G.shortest_path(df, 0, n - 1, most)
        assert [(x.cost, x.hops, -x.weakest, x.ids) for x in got.collect()] == ([want] if want else [])
        e, nodes = G.path_emphasis(df, got)
        ids = set(want[3]) if want else set()
        assert {x.id for x in e.where("on_path").collect()} == ids
        assert {x.id for x in nodes.where("on_path").collect()} == {v for i, a, b, *_ in edges if i in ids for v in (a, b)}
    empty = spark.createDataFrame([], "id string, a long, b long, cost long, confidence double")
    assert G.shortest_path(empty, 1, 2).count() == 0 and G.shortest_path(empty, 1, 1).first().hops == 0


def test_components_settle(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    got = {x.id: x.root for x in G.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


def plain_active(ops):
    """Operations from the last to the first: an active undo turns its target off."""
    off = set()
    for _, i, kind, target in sorted(ops, reverse=True):
        if kind == "undo" and i not in off:
            off.add(target)
    return {i: i not in off for _, i, _, _ in ops}


def test_long_and_branching_undo_chains(spark):
    r = random.Random(6)
    schema = "op_index long, id string, kind string, target string"
    for n in (70, 101):
        ops = [(0, "o0", "edit", None), *[(i, f"o{i}", "undo", f"o{i - 1}") for i in range(1, n)]]
        got = {x.id: x.active for x in G.active_operations(spark.createDataFrame(ops, schema)).collect()}
        assert got == plain_active(ops) and got["o0"] == (n % 2 == 1)
    ops = [(i, f"o{i}", "undo" if i and r.random() < 0.7 else "edit", f"o{r.randrange(i)}" if i else None) for i in range(24)]
    got = {x.id: x.active for x in G.active_operations(spark.createDataFrame(ops, schema)).collect()}
    assert got == plain_active([(i, o, k, t) for i, o, k, t in ops])


def test_lineage_of_any_length(spark):
    from talkgrid.operators import build as B

    splits = [(i + 1, i) for i in range(1, 90)] + [(200, 100), (300, 200), (7_000, 6_000)]
    ids = [(i,) for i in range(1, 91)] + [(100,), (300,), (999,)]
    got = {x.id: x.root for x in B.lineage_roots(spark.createDataFrame(splits, "child long, parent long"), spark.createDataFrame(ids, "id long")).collect()}
    assert got == {i: 1 if i <= 90 else 100 if i in (100, 300) else 999 for (i,) in ids}
    import pytest

    with pytest.raises(ValueError, match="ring"):
        B.lineage_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long"), spark.createDataFrame(ids, "id long"))


def test_undo_chains(spark):
    ops = [(0, "a", "edit", None), (1, "b", "undo", "a"), (2, "c", "edit", None), (3, "d", "undo", "b"), (4, "e", "undo", "c")]
    got = {r.id: r.active for r in G.active_operations(spark.createDataFrame(ops, "op_index long, id string, kind string, target string")).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": True}


def test_incident_edges_follow_long_chains(spark):
    chain = [(i + 1, i) for i in range(100, 130)] + [(7, 8), (8, 7), (6, 7)]
    edges = [(130, 1), (108, 2), (100, 3), (4, 109), (105, 101), (6, 5), (100, None)]
    f = spark.createDataFrame
    to = f(chain, "old_id long, new_id long")
    got = G.incident_edges(f(edges, "subject_id long, object_id long"), to, 100).collect()
    assert sorted((x.subject_id, x.object_id or 0) for x in got) == [(4, 100), (100, 0), (100, 1), (100, 2), (100, 3)]
    assert {x.old_id: x.target for x in G.chain_ends(to).collect()} == {i: 100 for i in range(101, 131)}
    assert [(x.subject_id, x.object_id) for x in G.incident_edges(f(edges, "subject_id long, object_id long"), to, 5).collect()] == [(6, 5)]


def test_entity_edges_of_many_suppliers(spark, tmp_path):
    from talkgrid.plans.registry import QUERIES

    rows = [(3 << 14, 1), (3, 1), (6, 1_000_003), (5, 1_000_003), (5, 2), (0, 3)]
    cols = "l_suppkey long, l_partkey long, l_shipdate timestamp, l_discount double"
    spark.createDataFrame([(s, p, None, 0.1) for s, p in rows], cols).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s,) for s, _ in rows], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {tuple(r) for r in QUERIES["entity_edges"](spark, str(tmp_path)).collect()} == {(1_000_003, 1, 2), (1_000_003, 1_000_003, 1)}
