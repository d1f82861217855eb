"""Exact set-similarity join on word shingles by universe-partition pigeonhole.

Sets are joined by size bands. For a band, H bounds the symmetric difference of any pair that links; the shingle
universe is dealt by hash into H + 1 segments. Giving each segment an allowance of 1 (equal segments match), 2
(segments of two or more elements that differ by one deletion match as well) or 0 (not looked at), with allowances adding up to H + 1, any
linking pair matches in a segment. Allowances follow cost: a segment's bucket grows as the segment shrinks, so an
empty one gets 0, made up for by a 2 on one of the reserved segments, for which every set also files its
one-deletion neighbours. A set with more empty segments than reserved ones to make up for them files the empty ones
too; a pair of which one side keeps its allowances is found by that side, other pairs by the filed empty segments.

The sets of a key are compared by parity sketches (one bit a hash bucket, in memory-mapped shared files): the number of
differing bits never exceeds the symmetric difference, so no linking pair is lost, while sets that share only a common
line or passage drop out. Of what remains a key gives a spanning forest, never its pairs; a sixteenth of the keys comes
first, and the other keys add only what those have not joined. A key of very many sets is first compared with a few
pivots, which joins near copies in linear time; if several trees remain, its sets go in blocks, pair by pair, to
other tasks. The forests' components hold every linking pair; each is verified exactly, in blocks of bounded size against
each other, and gives a spanning forest and link counts. Without link counts, blocks are verified in themselves and
against pivots of the component, and only components that this leaves in several trees are verified block by block.

Shards, files and tasks grow in number with the data, not in size.

Sets are known by a 64-bit hash of their sorted 64-bit shingle hashes, so copies are one set throughout.

Null or empty texts and texts without words have no shingles and link with nothing. With fewer words than a shingle
takes, the whole sequence is one. Repeated rows are copies. A null id never is the smallest while another is there.
Rows that share an id but not the text are documents of their own, linked or not as their texts are. An empty table
gives an empty one. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, column, cut, dealt, give_back, map_array, mix, new_shared_folder, pair_hash, put_bytes, steps, utf8
from .graph import components
from .idset import filter_rows, row_keys, write_rows

#: Sets of a component that are verified against as many others at once, and their shingles together.
BLOCK, BLOCK_SHINGLES = 1024, 250_000
#: Sets that every block of a component of several blocks holds besides its own where links are not counted.
PIVOTS = 16
#: Sets of one key that are compared where the key is gathered; of more, blocks of so many are dealt to tasks in pairs.
HOT = 1024
#: Shingles of all rows for each shard of keys, bytes of sketches and rows of labels for each file.
SHARD_SHINGLES, SHARD_BYTES, SHARD_LABELS = 1_500_000, 32 << 20, 1 << 21
#: Files that a worker keeps mapped at once.
OPEN_FILES = 2048
#: Keys gathered before a worker hands them on.
FLUSH = 700_000
_SEG, _EL, _DEL = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: list[bytes], words: WordHashes, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: A-Z lower-cased, words split at ASCII white space."""
    lists = [t.lower().split() for t in texts]
    h = words.of([w for x in lists for w in x])
    s = h.copy()
    for j in range(1, k):
        s = pair_hash(s[: max(0, len(h) - j)], h[j:])
    out, at = [], 0
    for x in lists:
        n = len(x)
        if n >= k:
            out.append(np.unique(s[at : at + n - k + 1]))
        elif n:
            v = h[at : at + 1]
            for j in range(1, n):
                v = pair_hash(v, h[at + j : at + j + 1])
            out.append(mix(v + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def set_hash(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


class Bands:
    """Size bands [lows[k], lows[k + 1]): a set of band k links only with sets of bands k - 1 to k + 1."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]

    def upto(self, size: int) -> None:
        while self.lows[-1] <= size:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)

    def of(self, size: int) -> int:
        self.upto(size)
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def segments(self, k: int) -> int:
        """H + 1 for pairs whose larger set lies in band k; 1 means equal sets only."""
        while len(self.lows) < k + 2:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        largest = self.lows[k + 1] - 1
        return 2 * largest * (100 - self.percent) // (100 + self.percent) + 1


def reserved(m: int, empty_share: float) -> int:
    """Reserved segments of m: all of a few, else the expected number of empty ones with five deviations, and one more.

    Any number is correct; with these, sets that have to file their empty segments are next to none.
    """
    e = m * empty_share
    return m if m <= 8 else min(m, math.ceil(1 + e + 5 * math.sqrt(e)))


def signatures(sets: list[np.ndarray], bands: Bands, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) of the scheme of each set's own band (shift 0) or of the next (shift 1)."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    band = np.fromiter((bands.of(int(n)) + shift if n else -1 for n in size), np.int64, len(size))
    m = np.fromiter((bands.segments(int(b)) if b >= 0 else 1 for b in band), np.int64, len(band))
    use = np.flatnonzero(m > 1)
    if not len(use):
        return none
    m, size, band = m[use], size[use], band[use]
    s = np.concatenate([sets[i] for i in use])
    own = np.repeat(np.arange(len(use)), size)
    base = np.concatenate([[0], np.cumsum(m)])
    x = mix(s * _SEG + band[own].astype(np.uint64))
    seg = ((x >> np.uint64(33)) * m[own].astype(np.uint64) >> np.uint64(31)).astype(np.int64)
    slot = base[own] + seg
    order = np.argsort(slot, kind="stable")
    el, slot_sorted = mix(x + _EL)[order], slot[order]
    start = np.flatnonzero(np.concatenate([[True], slot_sorted[1:] != slot_sorted[:-1]]))
    filled = slot_sorted[start]
    total = np.add.reduceat(el, start)
    of = np.repeat(np.arange(len(use)), m)
    number = np.arange(base[-1]) - base[of]
    salt = mix(number.astype(np.uint64) * _DEL + band[of].astype(np.uint64) * _SEG)
    sums = np.zeros(base[-1], np.uint64)
    sums[filled] = total
    sig = mix(sums + salt)
    here = np.zeros(base[-1], bool)
    here[filled] = True
    r = np.minimum(m, np.fromiter((_reserve_of(int(b), bands) for b in band), np.int64, len(band)))
    is_reserved = number >= (m - r)[of]
    empty = np.bincount(of[~here], minlength=len(use))
    held = np.zeros(base[-1], np.int64)
    held[filled] = np.diff(np.append(start, len(slot_sorted)))
    good = np.bincount(of[(held >= 2) & is_reserved], minlength=len(use))
    forced = empty > good
    file = here | forced[of]
    sigs, who = [sig[file]], [of[file]]
    # One-deletion neighbours of the reserved segments; those of one element make up for nothing and have none.
    res = is_reserved[slot_sorted] & (held[slot_sorted] >= 2)
    if res.any():
        at = slot_sorted[res]
        sigs.append(mix(sums[at] - el[res] + salt[at]))
        who.append(of[at])
    return np.concatenate(sigs), use[np.concatenate(who)]


def _reserve_of(band: int, bands: Bands) -> int:
    """The same for every set of a scheme: by the scheme's number of segments and its smallest sets."""
    m = bands.segments(band)
    low = bands.lows[max(0, band - 1)]
    return reserved(m, math.exp(-low / m))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's elements by hash bucket: a power of two of bits, 512 or as many as elements."""
    bits = max(512, 1 << (len(s) - 1).bit_length())
    at = (mix(s ^ _SEG) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(words: np.ndarray, bits: int) -> np.ndarray:
    """A sketch of more bits as one of fewer: parities of buckets that fall together."""
    return np.bitwise_xor.reduce(words.reshape(-1, bits // 64), axis=0)


class Sketches:
    """Sizes and sketches of sets in shared files, sharded by the set's hash and memory-mapped."""

    def __init__(self, folder: str, shards: int, full: list[int]):
        self.folder, self.shards, self.full, self.maps = folder, shards, set(full), {}

    def _open(self, k: int) -> tuple[np.ndarray, ...]:
        if k not in self.maps:
            if len(self.maps) >= OPEN_FILES:
                self.maps.pop(next(iter(self.maps)))
            self.maps[k] = tuple(map_array(f"{self.folder}/{k}.{x}", t) for x, t in (("node", np.int64), ("size", np.int64), ("at", np.int64), ("bits", np.uint64)))
        return self.maps[k]

    def get(self, nodes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sizes and sketch words of nodes."""
        size, words, shard = np.zeros(len(nodes), np.int64), [None] * len(nodes), np.mod(nodes, self.shards)
        for k in np.unique(shard).tolist():
            names, sizes, at, bits = self._open(k)
            mine = np.flatnonzero(shard == k)
            where = np.searchsorted(names, nodes[mine])
            size[mine] = sizes[where]
            for i, w in zip(mine.tolist(), where.tolist(), strict=True):
                words[i] = bits[at[w] : at[w + 1]]
        return size, words


def write_sketches(reps: DataFrame) -> Sketches:
    """reps: node, n_shingles, sketch; one row a node."""
    size = reps.agg(F.sum(F.octet_length("sketch") + 24).alias("n")).first()["n"] or 0
    folder, shards = new_shared_folder(reps.sparkSession, "sketches"), max(8, math.ceil(size / SHARD_BYTES))

    def write(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        k, node = key[0].as_py(), np.asarray(group.column("node"), np.int64)
        order = np.argsort(node)
        raw = [group.column("sketch")[int(i)].as_py() for i in order]
        put_bytes(f"{folder}/{k}.node", node[order].tobytes())
        put_bytes(f"{folder}/{k}.size", np.asarray(group.column("n_shingles"), np.int64)[order].tobytes())
        put_bytes(f"{folder}/{k}.at", np.concatenate([[0], np.cumsum(list(map(len, raw))) // 8]).astype(np.int64).tobytes())
        put_bytes(f"{folder}/{k}.bits", *raw)
        return pa.table({"shard": pa.array([k], pa.int32())})

    keyed = reps.select("node", "n_shingles", "sketch", F.pmod("node", F.lit(shards)).cast("int").alias("shard"))
    done = cut(dealt(keyed, "shard", shards).groupBy("shard").applyInArrow(write, "shard int"))
    return Sketches(folder, shards, [r["shard"] for r in done.collect()])


class Labels:
    """Node to component in shared files, sharded by the node; what isn't listed is its own component."""

    def __init__(self, folder: str, shards: int, full: list[int]):
        self.folder, self.shards, self.full = folder, shards, set(full)

    def of(self, nodes: np.ndarray) -> np.ndarray:
        out, shard = nodes.copy(), np.mod(nodes, self.shards)
        for k in np.unique(shard).tolist():
            if k in self.full:
                names, labels = (map_array(f"{self.folder}/{k}.{x}", np.int64) for x in ("node", "label"))
                mine = np.flatnonzero(shard == k)
                at = np.minimum(np.searchsorted(names, nodes[mine]), len(names) - 1)
                hit = names[at] == nodes[mine]
                out[mine[hit]] = labels[at[hit]]
        return out


def write_labels(components_: DataFrame) -> Labels:
    """components_ has been cut."""
    folder, shards = new_shared_folder(components_.sparkSession, "labels"), max(1, math.ceil(components_.count() / SHARD_LABELS))

    def write(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        k, node, label = key[0].as_py(), np.asarray(group.column("node"), np.int64), np.asarray(group.column("component"), np.int64)
        order = np.argsort(node)
        put_bytes(f"{folder}/{k}.node", node[order].tobytes())
        put_bytes(f"{folder}/{k}.label", label[order].tobytes())
        return pa.table({"shard": pa.array([k], pa.int32())})

    keyed = components_.select("node", "component", F.pmod("node", F.lit(shards)).cast("int").alias("shard"))
    done = cut(dealt(keyed, "shard", shards).groupBy("shard").applyInArrow(write, "shard int"))
    return Labels(folder, shards, [r["shard"] for r in done.collect()])


class Closeness:
    """Which pairs of nodes can link, by their sketches."""

    def __init__(self, sketches: Sketches, nodes: np.ndarray, percent: int):
        self.size, words = sketches.get(nodes)
        self.words, self.percent = words, percent
        self.width = np.asarray([len(w) for w in words], np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _table(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Sketches of at least ``width`` words, folded to it, and the row of each node."""
        if width not in self.tables:
            have = np.flatnonzero((self.width >= width) & (self.width <= 4 * width))  # sizes of a pair are within one band
            row = np.full(len(self.words), -1, np.int64)
            row[have] = np.arange(len(have))
            self.tables[width] = np.stack([fold(self.words[i], 64 * width) for i in have]) if len(have) else np.zeros((0, width), np.uint64), row
        return self.tables[width]

    def close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the nodes' sketches differ in no more bits than a linking pair's sets may differ in elements."""
        out = np.zeros(len(i), bool)
        most = (self.size[i] + self.size[j]) * (100 - self.percent) // (100 + self.percent)
        fits = np.abs(self.size[i] - self.size[j]) <= most
        small, large = np.minimum(self.width[i], self.width[j]), np.maximum(self.width[i], self.width[j])
        fits &= large <= 4 * small
        for width in np.unique(small[fits]).tolist():
            at = np.flatnonzero(fits & (small == width))
            table, row = self._table(width)
            step = max(1, (8 << 20) // (8 * width))
            for k in range(0, len(at), step):
                x = at[k : k + step]
                out[x] = np.bitwise_count(table[row[i[x]]] ^ table[row[j[x]]]).sum(1, dtype=np.int64) <= most[x]
        return out


class Forest:
    """Union-find over small integers; keeps the edges that joined."""

    def __init__(self, n: int):
        self.parent, self.edges = list(range(n)), []

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def merge(self, labels: np.ndarray) -> None:
        """Joins what has one label, without edges."""
        first: dict[int, int] = {}
        for i, k in enumerate(labels.tolist()):
            self.parent[i] = first.setdefault(k, i)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.find, nodes.tolist()), np.int64, len(nodes))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.edges.append((a, b))


def _compare(near: Closeness, forest: Forest, one: np.ndarray, two: np.ndarray) -> None:
    """Joins what is close of one and two (or of one with itself), block by block; what is joined already is not
    compared again."""
    step = 256
    for x in range(0, len(one), step):
        a = one[x : x + step]
        for y in range(x if one is two else 0, len(two), step):
            b = two[y : y + step]
            apart = forest.roots(a)[:, None] != forest.roots(b)[None, :]
            p, q = np.nonzero(np.triu(apart) if one is two and x == y else apart)
            if len(p):
                i, j = a[p], b[q]
                ok = near.close(i, j)
                forest.join(i[ok], j[ok])


def _by_pivots(near: Closeness, forest: Forest, m: np.ndarray, rounds: int = 3, pivots: int = 16) -> np.ndarray:
    """Compares all of m with a few sets of different trees, a few times: linear in m. The roots of m afterwards."""
    root = forest.roots(m)
    for _ in range(rounds):
        _, first, size = np.unique(root, return_index=True, return_counts=True)
        if len(first) == 1:
            break
        before = len(first)
        _compare(near, forest, m[first[np.argsort(-size, kind="stable")[:pivots]]], m)
        root = forest.roots(m)
        if len(np.unique(root)) > before // 2:  # these sets share little but the key
            break
    return root


def bucket_edges(sig: np.ndarray, node: np.ndarray, sketches: Sketches, percent: int, known: Labels | None = None) -> tuple[np.ndarray, list[dict]]:
    """(2, n) spanning edges of the pairs that share a key and are close by their sketches; none between nodes of which
    it is known that they belong together. Then the blocks of keys that are left to other tasks: see :func:`block_edges`."""
    none = np.zeros((2, 0), np.int64)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
    sig, node = sig[keep], node[keep]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    count = np.diff(np.append(first, len(sig)))
    if not (count > 1).any():
        return none, []
    nodes, member = np.unique(node[np.repeat(count > 1, count)], return_inverse=True)
    key = sig[first[count > 1]]
    count = count[count > 1]
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    near, forest = Closeness(sketches, nodes, percent), Forest(len(nodes))
    if known is not None:
        forest.merge(known.of(nodes))
    # Keys of few sets: their pairs, each once.
    pairs = []
    for n in range(2, 33):
        at = first[count == n]
        if len(at):
            m = np.unique(member[at[:, None] + np.arange(n)], axis=0)
            i, j = np.triu_indices(n, 1)
            pairs.append((m[:, i].ravel() << 32) | m[:, j].ravel())
    if pairs:
        p = np.unique(np.concatenate(pairs))
        i, j = p >> 32, p & 0xFFFFFFFF
        root = np.asarray([forest.find(v) for v in range(len(nodes))], np.int64)
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        ok = near.close(i, j)
        forest.join(i[ok], j[ok])
    # Keys of many, each set of members once: pivots first, then all against all, here or elsewhere.
    seen, blocks = set(), []
    for a, n, k in zip(first[count > 32].tolist(), count[count > 32].tolist(), key[count > 32].tolist(), strict=True):
        m = member[a : a + n]
        if (h := m.tobytes()) in seen:
            continue
        seen.add(h)
        root = _by_pivots(near, forest, m)
        if (root == root[0]).all():
            continue
        if n <= HOT:
            _compare(near, forest, m, m)
            continue
        many = -(-n // HOT)
        for x in range(many):
            part = slice(x * HOT, (x + 1) * HOT)
            blocks.append({"key": int(np.uint64(k).astype(np.int64)), "block": x, "blocks": many, "nodes": nodes[m[part]].tobytes(), "labels": nodes[root[part]].tobytes()})
    edges = nodes[np.asarray(forest.edges).T] if forest.edges else none
    return edges, blocks


def block_edges(blocks: DataFrame, sketches: Sketches, percent: int) -> DataFrame:
    """(a, b): spanning edges between the blocks of a key, every pair of blocks in a group of its own.

    blocks: key, block, blocks, nodes and labels (what has one label is joined already), as 64-bit values.
    """

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        parts = {r["block"]: (np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["labels"], np.int64)) for r in group.select(["block", "nodes", "labels"]).to_pylist()}
        names, labels = (np.concatenate(x) for x in zip(*parts.values(), strict=True))
        near, forest, n = Closeness(sketches, names, percent), Forest(len(names)), len(parts[key[1].as_py()][0])
        forest.merge(labels)
        every = np.arange(len(names))
        if len(parts) > 1:
            _compare(near, forest, *((every[:n], every[n:]) if next(iter(parts)) == key[1].as_py() else (every[-n:], every[:-n])))
        else:
            _compare(near, forest, every, every)
        e = names[np.asarray(forest.edges).T] if forest.edges else np.zeros((2, 0), np.int64)
        return pa.table({"a": pa.array(e[0]), "b": pa.array(e[1])})

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = blocks.withColumn("other", other).select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "nodes", "labels")
    return paired.groupBy("key", "p", "q").applyInArrow(compare, "a long, b long")


def _pack(sig: np.ndarray, node: np.ndarray, shards: int) -> Iterator[dict]:
    """For each shard the keys with their sets: the low 40 bits of a key and the set's number among the shard's here."""
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    shard = ((sig >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(shard, np.arange(shards + 1))
    for k, (i, j) in enumerate(pairwise(at)):
        if i < j:
            names, which = np.unique(node[i:j], return_inverse=True)
            yield {"shard": k, "nodes": names.tobytes(), "which": which.astype(np.uint16 if len(names) < 1 << 16 else np.uint32).tobytes(), "hi": (sig[i:j] >> np.uint64(32)).astype(np.uint8).tobytes(), "lo": sig[i:j].astype(np.uint32).tobytes()}


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("nodes", pa.binary()), ("labels", pa.binary())])
_BLOB = pa.schema([("shard", pa.int32()), ("nodes", pa.binary()), ("which", pa.binary()), ("hi", pa.binary()), ("lo", pa.binary())])


#: One key in so many is looked at first; what its buckets join needs no edges from the other keys' buckets.
FIRST = 16


def candidate_edges(docs: DataFrame, sketches: Sketches, k: int, percent: int, text: str = "text", first: bool | None = None, known: Labels | None = None, shards: int = 8) -> DataFrame:
    """(a, b): spanning edges, key by key, of the sets that share a key and may link. ``first`` takes one key in FIRST,
    or the others."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bands = WordHashes(), Bands(percent)
        sigs, nodes, held, seen = [], [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            for row in _pack(np.concatenate(sigs), np.concatenate(nodes), shards):
                yield pa.RecordBatch.from_pylist([row], _BLOB)
            sigs.clear()
            nodes.clear()
            seen.clear()

        for b in steps(batches, text, 1 << 20):
            sets = shingle_sets(utf8(b, text), words, k)
            names = list(map(set_hash, sets))
            new = [i for i, h in enumerate(names) if len(sets[i]) and h not in seen and not seen.add(h)]  # copies file once
            sets, names = [sets[i] for i in new], np.asarray([names[i] for i in new], np.int64)
            for shift in (0, 1) if new else ():
                sig, who = signatures(sets, bands, shift)
                if first is not None:
                    mine = (mix(sig) % np.uint64(FIRST) == 0) == first
                    sig, who = sig[mine], who[mine]
                sigs.append(sig)
                nodes.append(names[who])
                held += len(sig)
            if held >= FLUSH:
                yield from flush()
                held = 0
        if held:
            yield from flush()
        del words
        give_back()

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        sig, node = [], []
        for r in group.to_batches():
            for row in r.select(["nodes", "which", "hi", "lo"]).to_pylist():
                n = len(row["hi"])
                hi, lo = np.frombuffer(row["hi"], np.uint8), np.frombuffer(row["lo"], np.uint32)
                which = np.frombuffer(row["which"], np.uint16 if len(row["which"]) == 2 * n else np.uint32)
                sig.append((hi.astype(np.uint64) << np.uint64(32)) | lo)
                node.append(np.frombuffer(row["nodes"], np.int64)[which])
        e, blocks = bucket_edges(np.concatenate(sig), np.concatenate(node), sketches, percent, known)
        del sig, node
        give_back()
        edges = pa.table({"a": pa.array(e[0]), "b": pa.array(e[1])})
        return pa.concat_tables([pa.Table.from_pylist(blocks, _MET), edges], promote_options="default").select(_MET.names).cast(_MET)

    blobs = docs.select(text).mapInArrow(make, "shard int, nodes binary, which binary, hi binary, lo binary")
    met = cut(dealt(blobs, "shard", shards).groupBy("shard").applyInArrow(meet, "a long, b long, key long, block int, blocks int, nodes binary, labels binary"))
    edges, blocks = met.where("a is not null").select("a", "b"), met.where("a is null").drop("a", "b")
    return edges if blocks.isEmpty() else edges.unionByName(block_edges(blocks, sketches, percent))


def sets_of(docs: DataFrame, k: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, k1, k2, node, n_shingles, sketch) of every row; node and sketch are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in steps(batches):
            sets = shingle_sets(utf8(b), words, k)
            own = [column(b, c) for c in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "k1", "k2", "node", "n_shingles", "sketch"])
        del words
        give_back()

    one, two = row_keys(F.col(id_col), F.col(text))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), one.alias("k1"), two.alias("k2"))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, node long, n_shingles long, sketch binary")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of a with all of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    if len(a) * len(b) <= 4:
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                out[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return out
    every, count = np.unique(np.concatenate([*a, *b]), return_counts=True)
    shared = every[count > 1]
    cols = [[np.searchsorted(shared, x[np.isin(x, shared, assume_unique=True)]) for x in side] for side in (a, b)]
    width = 4096
    for lo in range(0, len(shared), width):
        dense = []
        for side in cols:
            d = np.zeros((len(side), width), np.float32)
            for i, c in enumerate(side):
                p, q = np.searchsorted(c, (lo, lo + width))
                d[i, c[p:q] - lo] = 1
            dense.append(d)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _forest(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges, each to the smallest node, of the graph with links between a[i] and b[j]."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(link), strict=True):
        x, y = find(int(a[i])), find(int(b[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, r) for x in parent if (r := find(x)) != x]


def verified(rows: DataFrame, k: int, percent: int, tasks: int) -> DataFrame:
    """rows: cluster, p, q, side, node, copies, text; dealt to ``tasks``. (a, b, links): spanning edges, and with b null link counts."""

    def links(group: list[dict], words: WordHashes) -> Iterator[tuple[int, int | None, int]]:
        every = [r | {"set": s} for r, s in zip(group, shingle_sets([r["text"] for r in group], words, k), strict=True)]
        same = group[0]["p"] == group[0]["q"]
        one = [r for r in every if same or r["side"] == group[0]["p"]]
        two = one if same else [r for r in every if r["side"] == group[0]["q"]]
        if not one or not two:
            return
        n1, n2 = (np.asarray([len(r["set"]) for r in x]) for x in (one, two))
        inter = _overlaps([r["set"] for r in one], [r["set"] for r in two])
        link = 100 * inter >= percent * (n1[:, None] + n2[None, :] - inter)
        if same:
            np.fill_diagonal(link, False)
        a, b = (np.asarray([r["node"] for r in x]) for x in (one, two))
        c1, c2 = (np.asarray([r["copies"] for r in x]) for x in (one, two))
        for x, y in _forest(link, a, b):
            yield x, y, 0
        yield from ((int(x), None, int(n)) for x, n in zip(a, link @ c2, strict=True) if n)
        if not same:
            yield from ((int(y), None, int(n)) for y, n in zip(b, link.T @ c1, strict=True) if n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, group, key, out, held = WordHashes(), [], None, [], set()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "links"])

        for b in batches:
            texts = utf8(b)
            for r, t in zip(b.drop_columns(["text"]).to_pylist(), texts, strict=True):
                now = (r["cluster"], r["p"], r["q"])
                if now != key and group:
                    out += links(group, words)
                    group, held = [], set()
                key = now
                if r["node"] not in held:  # rows that repeat id and text come several times
                    held.add(r["node"])
                    group.append(r | {"text": t})
            if len(out) > 50_000:
                yield batch()
                out = []
        if group:
            out += links(group, words)
        if out:
            yield batch()
        del words, group
        give_back()

    grouped = rows.repartition(tasks, "cluster", "p", "q").sortWithinPartitions("cluster", "p", "q")
    return grouped.mapInArrow(run, "a long, b long, links long")


#: Shares into which the rows of one component are dealt where they meet what is known of it.
_SALTS = 16


def _of_component(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """rows (node, component and others) with the columns of small (component and others, one row each); salted by the
    node, since a component may hold a third of all nodes."""
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")).join(salted, ["component", "_salt"], how).drop("_salt")


def _verify(docs: DataFrame, members: DataFrame, every: bool, k: int, percent: int, text: str, id_col: str) -> DataFrame:
    """(a, b, links) of the members' exact comparison; see :func:`verified`. members: node, component, k1, k2, copies,
    blocks, side, turn (of the node in its component). All pairs of blocks if ``every``, else each block with itself
    and with the component's first nodes."""
    found = filter_rows(docs.select(F.col(id_col), F.col(text)).toDF("doc_id", "text"), write_rows(members), True, carry=True)
    side, last = F.col("side"), F.col("blocks") - 1
    all_blocks = F.sequence(F.lit(0).cast("long"), last)
    other = F.explode(all_blocks if every else F.when(F.col("turn") <= PIVOTS, all_blocks).otherwise(F.array(side)))
    placed = found.select("k1", "k2", "text").join(members, ["k1", "k2"]).withColumn("other", other)
    p, q = (F.least("side", "other"), F.greatest("side", "other")) if every else (F.col("other"), F.col("other"))
    times = F.col("blocks") if every else F.lit(1)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((members.agg(F.sum(F.col("n_shingles") * times).alias("n")).first()["n"] or 0) / (2 * SHARD_SHINGLES)))
    return cut(verified(placed.select(F.col("component").alias("cluster"), p.alias("p"), q.alias("q"), "side", "node", "copies", "text"), k, percent, tasks))


def _groups(docs: DataFrame, k: int, percent: int, text: str, id_col: str, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, k1, k2, node, n_shingles) and the nodes: node, component_id, keeper (the one node of the component
    that holds the smallest id, null where the node is linked with none), n_links."""
    every = cut(sets_of(docs, k, text, id_col))
    some = every.where("node is not null")
    reps = cut(some.groupBy("node").agg(F.min_by(F.struct("doc_id", "k1", "k2"), F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("r"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch")))
    sketches = write_sketches(reps)
    reps = reps.select("node", F.col("r.doc_id").alias("rep"), "r.k1", "r.k2", "copies", "n_shingles")
    shards = max(8, math.ceil((reps.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0) / SHARD_SHINGLES))
    start = cut(candidate_edges(docs, sketches, k, percent, text, first=True, shards=-(-shards // 4)))
    rest = candidate_edges(docs, sketches, k, percent, text, first=False, known=write_labels(cut(components(start))), shards=shards)
    clusters = cut(components(start.unionByName(rest)).join(reps, "node"))
    blocks = clusters.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    members = _of_component(clusters, blocks).withColumn("side", F.pmod(F.xxhash64("node"), "blocks"))
    if not count_links:
        # The first nodes of a component of several blocks, found in its salted shares first.
        salt = F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(64))
        share = F.row_number().over(Window.partitionBy("component", salt).orderBy("node"))
        front = members.where("blocks > 1").withColumn("n", share).where(F.col("n") <= PIVOTS)
        front = front.withColumn("turn", F.row_number().over(Window.partitionBy("component").orderBy("node"))).where(F.col("turn") <= PIVOTS)
        members = members.join(front.select("node", "turn"), "node", "left").withColumn("turn", F.coalesce("turn", F.lit(PIVOTS + 1)))
    members = cut(members)
    found = _verify(docs, members, count_links, k, percent, text, id_col)
    linked = components(found.where("b is not null").select("a", "b"))
    if not count_links:
        linked = cut(linked)
        large = members.where("blocks > 1").select("node", F.col("component").alias("cluster")).join(linked, "node", "left")
        split = large.groupBy("cluster").agg(F.min(F.coalesce("component", "node")).alias("lo"), F.max(F.coalesce("component", "node")).alias("hi")).where("lo <> hi")
        split = cut(split.select(F.col("cluster").alias("component")))
        if not split.isEmpty():
            again = cut(_of_component(members, split))
            found = found.unionByName(_verify(docs, again, True, k, percent, text, id_col))
            linked = components(found.where("b is not null").select("a", "b"))
    first = F.min_by(F.struct("rep", F.col("node").alias("keeper")), F.struct(F.col("rep").isNull(), "rep", "node"))
    low = linked.join(reps.select("node", "rep"), "node").groupBy("component").agg(first.alias("f"))
    grouped = _of_component(linked, low).select("node", F.col("f.rep").alias("low"), F.col("f.keeper").alias("keeper"))
    nodes = reps.join(grouped, "node", "left")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    nodes = nodes.join(links, "node", "left") if count_links else nodes.withColumn("links", F.lit(None).cast("long"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return every.drop("sketch"), nodes.select(F.col("node").alias("n"), F.coalesce("low", "rep").alias("component_id"), "keeper", n_links.cast("long").alias("n_links"))


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest id reachable by links, its own
    included) and n_links (other rows it links with, copies included)."""
    every, nodes = _groups(docs, k, percent, text, id_col, count_links=True)
    out = every.join(nodes, F.col("node") == F.col("n"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text and others) with one document of each group: of the rows with the group's smallest doc_id those
    of one text.

    Rows are removed by id and text together, so a row whose text is in no group stays even if another row with its id
    goes. Rows that repeat the kept id and text stay, and so do rows with a null id, and rows without words. The columns
    are those of docs, whatever their names.
    """
    every, nodes = _groups(docs, k, percent, "text", "doc_id", count_links=False)
    rows = every.where("doc_id is not null").join(nodes, F.col("node") == F.col("n"))
    gone = rows.where((F.col("doc_id") != F.col("component_id")) | (F.col("node") != F.coalesce("keeper", "node"))).select("k1", "k2")
    return filter_rows(docs, write_rows(gone), keep_members=False)
