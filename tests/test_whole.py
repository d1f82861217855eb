"""Operators do the whole job: no row is lost to a window, a cap of rounds or a subset."""

import random

from talkgrid.operators import build as B
from talkgrid.operators import graph as G
from talkgrid.operators import joins as J
from talkgrid.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_nearest_position_at_any_distance(spark):
    r = random.Random(11)
    events = [(i, r.randrange(4), r.randrange(400_000)) for i in range(150)] + [(150, 0, None), (151, None, 5)]
    positions = [(i, r.randrange(3), r.choice((0, 350_000)) + r.randrange(40) * 100) for i in range(40)]
    got = {x.event_id: x.position_id for x in J.nearest_position(spark.createDataFrame(events, "event_id long, source long, t long"), spark.createDataFrame(positions, "position_id long, source long, at long"), 1000).collect()}
    plain = lambda s, t: min(((abs(t - at), at, i) for i, source, at in positions if source == s), default=(None,))[-1]
    assert got == {i: None if s is None or t is None else plain(s, t) for i, s, t in events}


def test_long_sessions_are_cut_until_every_part_fits(spark):
    r = random.Random(12)
    rows = [(k, i, float(r.randrange(6)), n) for k, n in enumerate((20, 21, 45, 203)) for i in range(n)]

    def plain(levels, most, low, window):
        off, out = 0, []
        while len(levels) - off > most:
            starts = range(off + low, off + most - window + 1)
            off = min(starts, key=lambda s: (sum(levels[s : s + window]), s)) + window // 2
            out.append(off)
        return out

    df = spark.createDataFrame(rows, "key long, i long, level double, n long")
    for window in (1, 4):
        got = {}
        for x in B.hard_splits(df, 20, 0.3, window).orderBy("at").collect():
            got.setdefault(x.key, []).append(x["at"])
        want = {k: plain([x for key, _, x, _ in rows if key == k], 20, 14, window) for k in range(1, 4)}
        assert got == want and len(want[3]) >= 10


def plain_components(edges, nodes):
    """[(edges, confidence, root, ids)] by rank. edges: (id, a, b, confidence); nodes: id to (notes, mentions)."""
    near = {}
    for _, a, b, c in edges:
        if a != b and a in nodes and b in nodes:
            near.setdefault(a, []).append((b, c))
            near.setdefault(b, []).append((a, c))
    seen, out = set(), []
    for first in near:
        if first not in seen:
            ids, todo = [], [first]
            seen.add(first)
            while todo:
                ids.append(x := todo.pop())
                todo += {n for n, _ in near[x]} - seen
                seen |= {n for n, _ in near[x]}
            root = min(ids, key=lambda x: (-len(near[x]), -sum(c for _, c in near[x]), -nodes[x][0], -nodes[x][1], x))
            out.append((sum(len(near[x]) for x in ids) // 2, sum(c for x in ids for _, c in near[x]) / 2, root, sorted(ids)))
    return sorted(out, key=lambda c: (-c[0], -c[1], c[2]))


def some_graph(seed, n, m):
    r = random.Random(seed)
    edges = [(f"e{i:04d}", r.randrange(n), r.randrange(n), r.randrange(1, 9) / 8) for i in range(m)]
    return edges, {i: (r.randrange(5), r.randrange(9)) for i in range(n) if i % 17}


def frames(spark, edges, nodes):
    return spark.createDataFrame(edges, "id string, a long, b long, confidence double"), spark.createDataFrame([(i, *x) for i, x in nodes.items()], "id long, note_count long, mention_total long")


def test_components_are_ranked(spark):
    edges, nodes = some_graph(13, 120, 90)
    got = {x.id: (x.edges, x.confidence, x.root) for x in G.ranked_components(*frames(spark, edges, nodes)).collect()}
    assert got == {i: c[:3] for c in plain_components(edges, nodes) for i in c[3]}


def test_components_take_all_lines(spark):
    got = QUERIES["components"](spark, SF).collect()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect()
    nodes = {x: (0, 0) for a, b in lines for x in (a + 1_000_000, b)}
    want = plain_components([("", a + 1_000_000, b, 1.0) for a, b in lines], nodes)
    groups = {}
    for x in got:
        groups.setdefault((x.root, x.edges), []).append(x.id)
    assert sorted((n, sorted(ids)) for (_, n), ids in groups.items()) == sorted((c[0], c[3]) for c in want)


def test_greedy_pairs_leave_none(spark):
    r = random.Random(14)
    n = 100
    additive = [(a, b, -(a + b) * 1.0) for a in range(n) for b in range(a + 1, n)]
    tied = [(a, b, float(r.randrange(5))) for a in range(30) for b in range(a + 1, 30)]
    for pairs, rounds in ((additive, 2), (additive, 40), (tied, 40), (tied, 0)):
        used, want = set(), set()
        for _, a, b in sorted((x, a, b) for a, b, x in pairs):
            if not {a, b} & used:
                used |= {a, b}
                want.add((a, b))
        got = [(x.a, x.b) for x in B.greedy_pairs(spark.createDataFrame(pairs, "a long, b long, rank double"), rounds).collect()]
        assert len(got) == len(want) and set(got) == want


def plain_backbone(edges, nodes, most, per):
    edges = [e for e in edges if e[1] != e[2] and e[1] in nodes and e[2] in nodes]
    shown = [c[2] for c in plain_components(edges, nodes)][:most]
    queues = [[x] for x in shown]
    while len(shown) < most and any(queues):
        for q in queues:
            if q:
                node, best = q.pop(0), {}
                for i, a, b, c in edges:
                    other = b if a == node else a if b == node else None
                    if other is not None and other not in shown:
                        best[other] = min(best.get(other, (9,)), (-c, i))
                new = sorted(best, key=best.get)[:per][: most - len(shown)]
                shown += new
                q += new
    if not any(a in shown and b in shown for _, a, b, _ in edges):
        _, a, b, _ = min(edges, key=lambda e: (-e[3], e[0]))
        for x in shown[::-1]:
            if len({*shown, a, b}) > most and x not in (a, b):
                shown.remove(x)
        shown += [x for x in (a, b) if x not in shown]
    return shown


def test_backbone_shows_every_component(spark):
    for seed, n, m, most in ((15, 120, 90, 80), (16, 60, 200, 30), (17, 120, 60, 6)):
        edges, nodes = some_graph(seed, n, m)
        e, v = frames(spark, edges, nodes)
        got = [x.id for x in B.backbone(e.selectExpr("*", "1 AS note_count"), v, most).orderBy("at").collect()]
        assert got == plain_backbone(edges, nodes, most, 3)
        roots = [c[2] for c in plain_components(edges, nodes)]
        assert len(roots) > most or set(roots) <= set(got)


def test_whole_tables_are_taken(spark):
    n = lambda name: QUERIES[name](spark, SF).count()
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    assert n("mention_resolvability") == table("lineitem").count() and n("attendee_people") == table("customer").count()
    assert QUERIES["alias_matches"](spark, SF).where("id = match_id").count() == table("part").count()
