"""Interpolated modified Kneser-Ney language model (bigrams), counted in Spark, kept as sorted hash arrays in shared
files and memory-mapped by the workers that score.

Tokens: A-Z lower-cased words between ASCII white space, and one end mark a text; contexts start with a begin mark.
p(w | v) = (c(vw) - D(c(vw))) / c(v.) + g(v) p(w), p(w) = (n(.w) - D(n(.w))) / n(..) + g0 / (V + 1), with the three
discounts of each order from its counts of counts; n counts distinct predecessors, V the distinct tokens.

Counting: workers hand on sorted (context, word, count) arrays by shard of the context; a shard merges them, writes
its pairs and contexts, and hands on (word, predecessors, tokens) by shard of the word, which writes the words. A
shard takes a bounded share of the text, is a task of its own (beyond ``common.MAX_TASKS`` a task takes several, one after another),
and is one file of sorted arrays. What a worker hands on has one entry for each distinct pair, so very
frequent words and pairs stay small. Nothing of the corpus's size comes to the driver or is broadcast. A scorer maps the
files that a batch's tokens fall into when it needs them, and at most ``OPEN_FILES`` at once.

Null texts count as empty: an end mark alone. Repeated rows count each time. With nothing to learn from, N = V = 0:
every token has probability 1 / (V + 1). Empty tables give empty ones; other columns pass, but for those of the names that
scoring adds, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, dealt, give_back, map_array, mix, new_shared_folder, pair_hash, put_bytes, steps, utf8

BEGIN, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
#: Text bytes whose pairs make one shard.
SHARD_BYTES = 24 << 20
#: Tokens counted before a worker hands its counts on.
FLUSH = 3_000_000
#: Files that a scorer keeps mapped at once; a system allows a process some 65,000 maps.
OPEN_FILES = 8192
#: The arrays of a shard's two files, in order.
_PAIR_FILE = (("pair", np.uint64), ("big", np.uint64), ("big_n", np.int64), ("ctx", np.uint64), ("ctx_n", np.int64), ("pair_n", np.uint8))
_WORD_FILE = (("word", np.uint64), ("kinds", np.int64), ("tokens", np.int64))


def token_stream(texts: list[bytes], words: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token, first position of each text) hashes over the texts in turn."""
    lists = [t.lower().split() for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    start = np.concatenate([[0], np.cumsum(n + 1)])
    tok = np.empty(start[-1], np.uint64)
    ends = start[1:] - 1
    plain = np.ones(len(tok), bool)
    plain[ends] = False
    tok[ends] = END
    tok[plain] = words.of([w for x in lists for w in x])
    ctx = np.empty_like(tok)
    ctx[1:] = tok[:-1]
    ctx[start[:-1]] = BEGIN
    return ctx, tok, start[:-1]


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _sum_runs(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]) -> tuple[tuple, tuple]:
    """Sorts by keys (last one first) and adds the values of equal keys."""
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return tuple(k[at] for k in keys), tuple(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


def _narrow(c: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 and more behind them."""
    big = np.flatnonzero(c >= 255)
    return np.minimum(c, 255).astype(np.uint8).tobytes() + c[big].astype(np.uint64).tobytes()


def _wide(b: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(b, np.uint8, n).astype(np.int64)
    c[c == 255] = np.frombuffer(b, np.uint64, -1, n).astype(np.int64)
    return c


_PAIRS = pa.schema([("shard", pa.int32()), ("contexts", pa.binary()), ("runs", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
_WORDS = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("kinds", pa.binary()), ("tokens", pa.binary()), ("n1", pa.int64()), ("n2", pa.int64()), ("n3", pa.int64()), ("n4", pa.int64()), ("kind_sum", pa.int64())])


def _pair_rows(ctx: np.ndarray, tok: np.ndarray, count: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    (s, v, w), (c,) = _sum_runs((shard_of(ctx, shards), ctx, tok), (count,))
    at = np.searchsorted(s, np.arange(shards + 1))
    for k, (i, j) in enumerate(pairwise(at)):
        if i < j:
            new = np.flatnonzero(np.concatenate([[True], v[i + 1 : j] != v[i : j - 1]]))
            runs = np.diff(np.append(new, j - i))
            yield pa.RecordBatch.from_pylist([{"shard": k, "contexts": v[i:j][new].tobytes(), "runs": _narrow(runs), "words": w[i:j].tobytes(), "counts": _narrow(c[i:j])}], _PAIRS)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the counts of counts one to four; plain steps where counts are missing."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


@dataclass
class Model:
    folder: str
    shards: int
    tokens: int
    distinct: int
    kinds: int
    pair_d: tuple
    word_d: tuple
    word_mass: float

    def open(self, kind: str, k: int) -> dict[str, np.ndarray]:
        """The arrays of a shard's file, memory-mapped: nothing is read until it is looked up."""
        parts = _PAIR_FILE if kind == "pairs" else _WORD_FILE
        try:
            raw = map_array(f"{self.folder}/{k}.{kind}", np.uint8)
        except FileNotFoundError:  # no pair or word fell into this shard
            return {name: np.zeros(0, t) for name, t in parts}
        sizes = raw[: 8 * len(parts)].view(np.int64)
        ends = 8 * len(parts) + np.cumsum(sizes)
        return {name: raw[end - n : end].view(t) for (name, t), n, end in zip(parts, sizes.tolist(), ends.tolist(), strict=True)}


def _put(uri: str, parts: tuple, arrays: dict[str, np.ndarray]) -> None:
    """One file: the sizes of the arrays, then the arrays."""
    flat = [np.ascontiguousarray(arrays[name], t).reshape(-1) for name, t in parts]
    put_bytes(uri, np.asarray([a.nbytes for a in flat], np.int64).tobytes(), *[memoryview(a).cast("B") for a in flat if a.size])  # no copies


def _find(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions of sorted x in sorted a; -1 where absent."""
    if not len(a):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(a, x), len(a) - 1)
    return np.where(a[i] == x, i, -1)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Counts the model of all rows' whole texts and writes it below the shared folder."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    shards = max(6, math.ceil(total / SHARD_BYTES))
    folder = new_shared_folder(spark, "lm")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = WordHashes(), [], 0
        for b in steps(batches, text):
            ctx, tok, _ = token_stream(utf8(b, text), words)
            (v, w), (c,) = _sum_runs((ctx, tok), (np.ones(len(tok), np.int64),))
            held.append((v, w, c.astype(np.int32)))
            n += len(v)
            if n >= FLUSH:
                yield from _pair_rows(*(np.concatenate(x) for x in zip(*held, strict=True)), shards)
                held, n = [], 0
        if held:
            yield from _pair_rows(*(np.concatenate(x) for x in zip(*held, strict=True)), shards)
        del words, held
        give_back()

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        k, parts = key[0].as_py(), []
        for b in group.to_batches():
            for r in b.to_pylist():
                v, w = np.frombuffer(r["contexts"], np.uint64), np.frombuffer(r["words"], np.uint64)
                parts.append((np.repeat(v, _wide(r["runs"], len(v))), w, _wide(r["counts"], len(w)).astype(np.int32)))
        v, w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        (v, w), (c,) = _sum_runs((v, w), (c.astype(np.int64),))
        new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        # Contexts: total, and how many words were seen once, twice, more often.
        stats = np.stack([np.add.reduceat(x, new) for x in (c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))], axis=1)
        h = pair_hash(v, w)
        order = np.argsort(h)
        h, hc = h[order], c[order]
        big = hc >= 255
        _put(f"{folder}/{k}.pairs", _PAIR_FILE, {"pair": h, "pair_n": np.minimum(hc, 255), "big": h[big], "big_n": hc[big], "ctx": v[new], "ctx_n": stats})
        del h, order, hc
        rows = [{"shard": shards, "words": b"", "kinds": b"", "tokens": b"", **{f"n{i}": int((c == i).sum()) for i in (1, 2, 3, 4)}, "kind_sum": len(c)}]
        (s, w), (kinds, toks) = _sum_runs((shard_of(w, shards), w), (np.ones(len(w), np.int64), c))
        for j, (a, z) in enumerate(pairwise(np.searchsorted(s, np.arange(shards + 1)))):
            if a < z:
                rows.append({"shard": j, "words": w[a:z].tobytes(), "kinds": _narrow(kinds[a:z]), "tokens": _narrow(toks[a:z]), "n1": 0, "n2": 0, "n3": 0, "n4": 0, "kind_sum": 0})
        return pa.Table.from_pylist(rows, _WORDS)

    def words_of(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        k = key[0].as_py()
        sums = [int(pa.compute.sum(group.column(c)).as_py()) for c in ("n1", "n2", "n3", "n4", "kind_sum")]
        if k == shards:  # the counts of counts of all pairs
            return pa.table({"kind": ["pairs"], "n": [sums[:4]], "distinct": [0], "sum": [sums[4]], "tokens": [0]})
        parts = []
        for r in (r for b in group.to_batches() for r in b.to_pylist()):
            w = np.frombuffer(r["words"], np.uint64)
            parts.append((w, _wide(r["kinds"], len(w)), _wide(r["tokens"], len(w))))
        w, kinds, toks = (np.concatenate(x) for x in zip(*parts, strict=True))
        (w,), (kinds, toks) = _sum_runs((w,), (kinds, toks))
        _put(f"{folder}/{k}.words", _WORD_FILE, {"word": w, "kinds": kinds, "tokens": toks})
        return pa.table({"kind": ["words"], "n": [[int((kinds == i).sum()) for i in (1, 2, 3, 4)]], "distinct": [len(w)], "sum": [int(kinds.sum())], "tokens": [int(toks.sum())]})

    pairs = docs.select(text).mapInArrow(count, "shard int, contexts binary, runs binary, words binary, counts binary")
    merged = dealt(pairs, "shard", shards).groupBy("shard").applyInArrow(merge, "shard int, words binary, kinds binary, tokens binary, n1 long, n2 long, n3 long, n4 long, kind_sum long")
    done = dealt(merged, "shard", shards + 1).groupBy("shard").applyInArrow(words_of, "kind string, n array<long>, distinct long, sum long, tokens long")
    # The files exist once this ran; three rows of sums a shard come back.
    sums = cut(done).groupBy("kind").agg(*[F.sum(F.col("n")[i]).alias(f"n{i + 1}") for i in range(4)], *[F.sum(c).alias(c) for c in ("distinct", "sum", "tokens")]).collect()
    by = {r["kind"]: r for r in sums}
    if "words" not in by:
        return Model(folder, shards, 0, 0, 0, (0.5,) * 3, (0.5,) * 3, 1.0)
    w, p = by["words"], by["pairs"]
    d = discounts([w[f"n{i}"] for i in (1, 2, 3, 4)])
    mass = (d[0] * w["n1"] + d[1] * w["n2"] + d[2] * (w["distinct"] - w["n1"] - w["n2"])) / w["sum"]
    return Model(folder, shards, w["tokens"], w["distinct"], w["sum"], discounts([p[f"n{i}"] for i in (1, 2, 3, 4)]), d, mass)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard met, with the rising positions of what falls into it."""
    order = np.argsort(shard, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]])) if len(shard) else np.zeros(0, np.int64)
    for a, z in pairwise([*first.tolist(), len(shard)]):
        yield int(shard[order[a]]), order[a:z]


def _discount(d: tuple, c: np.ndarray) -> np.ndarray:
    return np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0)))


class Scorer:
    """Looks tokens and pairs up in the memory-mapped arrays of the shards that they fall into."""

    def __init__(self, model: Model):
        self.m, self.maps = model, {}

    def _open(self, kind: str, k: int) -> dict[str, np.ndarray]:
        if (kind, k) not in self.maps:
            if len(self.maps) >= OPEN_FILES:  # the one mapped first goes
                self.maps.pop(next(iter(self.maps)))
            self.maps[kind, k] = self.m.open(kind, k)
        return self.maps[kind, k]

    def _words(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kinds, toks, shard = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), shard_of(w, self.m.shards)
        for k, at in _by_shard(shard):
            maps = self._open("words", k)
            i = _find(maps["word"], w[at])
            ok = i >= 0
            kinds[at[ok]], toks[at[ok]] = maps["kinds"][i[ok]], maps["tokens"][i[ok]]
        return kinds, toks

    def __call__(self, ctx: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token count in training, probability in context) of each token."""
        m = self.m
        w, at_w = np.unique(tok, return_inverse=True)
        kinds, toks = self._words(w)
        uniform = 1.0 / (m.distinct + 1)
        p_word = (np.maximum(kinds - _discount(m.word_d, kinds), 0) / max(1, m.kinds) + m.word_mass * uniform)[at_w]
        v, at_v = np.unique(ctx, return_inverse=True)
        stats, vs = np.zeros((len(v), 4), np.int64), shard_of(v, m.shards)
        shard = vs[at_v]
        h, where, at_h = np.unique(pair_hash(ctx, tok), return_index=True, return_inverse=True)
        c_h, s_h = np.zeros(len(h), np.int64), shard[where]
        contexts, pairs = dict(_by_shard(vs)), dict(_by_shard(s_h))
        for k, at in contexts.items():
            maps = self._open("pairs", k)
            i = _find(maps["ctx"], v[at])
            ok = i >= 0
            stats[at[ok]] = maps["ctx_n"].reshape(-1, 4)[i[ok]]
            at = pairs[k]  # a context has a pair
            i = _find(maps["pair"], h[at])
            ok = i >= 0
            got = maps["pair_n"][i[ok]].astype(np.int64)
            large = got == 255
            if large.any():
                got[large] = maps["big_n"][_find(maps["big"], h[at[ok]][large])]
            c_h[at[ok]] = got
        c = c_h[at_h]
        total = stats[at_v, 0]
        d = m.pair_d
        back = (stats[:, 1:] * np.asarray(d)).sum(1)[at_v]
        seen = total > 0
        p = p_word.copy()
        p[seen] = (np.maximum(c - _discount(d, c), 0)[seen] + back[seen] * p_word[seen]) / total[seen]
        return toks[at_w], p


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10 of the whole text's probability)."""
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    source = docs.select(*[c for c in docs.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, look = WordHashes(), Scorer(model)
        for b in steps(batches, text):
            ctx, tok, start = token_stream(utf8(b, text), words)
            count, p = look(ctx, tok)
            base = np.log10((count + 1) / (model.tokens + 1.0 * (model.distinct + 1)))
            n = np.diff(np.append(start, len(tok)))
            add = lambda x: np.add.reduceat(x, start)
            cols = [pa.array(n), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])
        del words
        give_back()

    from pyspark.sql.types import DoubleType, LongType, StructType

    schema = StructType([*source.schema.fields])
    for n in names:
        schema = schema.add(n, LongType() if n.startswith(("n_", "train")) else DoubleType())
    return source.mapInArrow(run, schema)
