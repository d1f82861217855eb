"""Groups of near copies: hot keys, components of several blocks, and which documents stay."""

import random

import numpy as np
import pytest

from talkgrid.llm import idset, simjoin
from tests.llm.test_sets_and_media import WORD, brute


def near_copies(r, n, words, size=120, edits=3):
    base = [r.choice(words) for _ in range(size)]
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(r.randrange(edits + 1)):
            x[r.randrange(size)] = r.choice(words)
        out.append(" ".join(x))
    return out


class Held:
    """Sketches in memory."""

    def __init__(self, sets):
        self.sets = sets

    def get(self, nodes):
        found = [self.sets[int(n)] for n in nodes]
        return np.asarray(list(map(len, found))), [np.frombuffer(simjoin.sketch(s), np.uint64) for s in found]


def test_a_hot_key_is_dealt_in_blocks(spark, monkeypatch):
    """20,000 sets share a key, two copies out of line among them; what one task compares grows with its sets."""
    rng = np.random.default_rng(5)
    common, compared = rng.integers(0, 1 << 62, 20, dtype=np.uint64), []
    sets = {i: np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 60, dtype=np.uint64)])) for i in range(20_000)}
    sets[19_999] = np.unique(np.append(sets[2_003][:-1], np.uint64(9)))
    sets[4_711] = np.unique(np.append(sets[4_712][:-1], np.uint64(8)))
    close = simjoin.Closeness.close
    monkeypatch.setattr(simjoin.Closeness, "close", lambda self, i, j: (compared.append(len(i)), close(self, i, j))[1])
    counts = []
    for n in (5_000, 10_000, 20_000):
        compared.clear()
        edges, blocks = simjoin.bucket_edges(np.zeros(n, np.uint64), np.arange(n), Held(sets), 90)
        counts.append(sum(compared))
        assert len(blocks) == -(-n // simjoin.HOT) and not edges.size
    assert counts[2] < 2.2 * counts[1] < 5 * counts[0] and counts[0] <= 16 * 3 * 5_000
    few = [b for b in blocks if b["block"] in (1, 4, 19)]
    few = [b | {"block": i, "blocks": 3} for i, b in enumerate(few)]
    monkeypatch.undo()
    got = simjoin.block_edges(spark.createDataFrame(few, "key long, block int, blocks int, nodes binary, labels binary"), Held(sets), 90)
    assert {tuple(sorted(r)) for r in got.collect()} == {(2_003, 19_999), (4_711, 4_712)}


def test_near_copies_of_a_hot_key_are_joined_in_place():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 100, dtype=np.uint64)
    sets = {i: np.unique(np.append(base[1:], np.uint64(i))) for i in range(5_000)}
    edges, blocks = simjoin.bucket_edges(np.zeros(5_000, np.uint64), np.arange(5_000), Held(sets), 90)
    assert not blocks and edges.shape[1] == 4_999


@pytest.mark.parametrize("count_links", [True, False])
def test_components_of_many_blocks(spark, monkeypatch, count_links):
    """Hot keys, blocks and pivots of a few sets; a chain of copies whose ends have nothing in common."""
    for name, n in (("HOT", 40), ("BLOCK", 16), ("PIVOTS", 2), ("SHARD_SHINGLES", 2_000)):
        monkeypatch.setattr(simjoin, name, n)
    monkeypatch.setattr(idset, "SHARD_ROWS", 50)
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = near_copies(r, 150, words) + near_copies(r, 40, words, 60, 1)
    chain = [f"c{i}" for i in range(60)]
    for i in range(90):
        texts.append(" ".join(chain))
        chain = [*chain[1:], f"d{i}"]
    line = " ".join(f"l{i}" for i in range(30))
    texts += [f"{line} " + " ".join(r.choice(words) for _ in range(20)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(r.sample(texts, len(texts)))]
    want = brute(rows, 3, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if count_links:
        assert {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in simjoin.similar_groups(docs, 3, 90).collect()} == want
    else:
        assert sorted(x.doc_id for x in simjoin.keep_one(docs, 3, 90).collect()) == sorted({c for _, c, _ in want.values()})


def test_rows_go_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (6, b + " more"), (6, c), (6, c), (7, c), (8, ""), (8, None), (None, c), (3, a + " z")]
    got = sorted(map(str, (tuple(r) for r in simjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    # Of document 3's two texts one stays; b stays as 5, c as 6 (its repeated row too), and what has no id or no words.
    kept = [r for r in rows if r not in [(5, a), (6, b + " more"), (7, c), (3, a), (3, a + " z")]]
    three = [x for x in got if x.startswith("(3,")]
    assert len(three) == 1 and sorted([*map(str, kept), *three]) == got


def test_keep_one_is_the_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 5, 80)
    got = sorted(r.doc_id for r in simjoin.keep_one(docs).collect())
    assert got == sorted({c if WORD.search(t or "") else d for (d, t), (_, c, _) in zip(rows, want.values(), strict=True)})
