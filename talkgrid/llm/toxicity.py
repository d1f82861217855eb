"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (3 to 6 characters, within a word with its ends marked) in a text, times
the log ratio of its smoothed document frequency in toxic and in other texts. Every n-gram of the labelled texts is
counted; those that tell the classes apart by a chi-square test (whose approximation asks for five texts at least) are
features, however many there are. Logistic regression is fitted on the scaled features.

The fit reads at most ``MAX_ROWS`` different labelled rows (those with the smallest hash of doc_id and text, so the same
ones in every run); everything is scored, over whole texts. Null and empty texts have no feature and get the score of the
intercept. With no label, or only one class, every score is the smoothed share of label 1. Repeated rows count once in the
fit and get equal scores; other columns pass. Empty tables give empty ones.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import column, cut, give_back, mix, steps

ORDERS = (3, 4, 5, 6)
#: Bits of an n-gram's hash: so many that the n-grams of a bounded sample are practically never mixed up.
BITS = 48
#: Labelled rows that a fit reads at most.
MAX_ROWS = 16_000
#: Chi-square of one degree of freedom at 0.001, and the texts that the test asks for.
CHI_SQUARE, LEAST_TEXTS = 10.83, 5
#: Bits by which the sorted features are entered.
_FRONT = 19


class Features:
    """Sorted n-gram hashes; a table by their first bits leaves few to search for."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.front = np.zeros(1 << _FRONT, bool)
        self.front[hashes >> (BITS - _FRONT)] = True

    def number(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are features, and their numbers."""
        at = np.flatnonzero(self.front[h >> (BITS - _FRONT)])
        i = np.searchsorted(self.hashes, h[at])
        i[i == len(self.hashes)] = 0
        hit = self.hashes[i] == h[at] if len(self.hashes) else np.zeros(0, bool)
        return at[hit], i[hit]


def presence(texts: list[str | None], keep: Features | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text number, n-gram hash) pairs, or with ``keep`` (text number, feature number); 65,536 texts at most."""
    sep = " \n\n\n\n\n "
    joined = sep + sep.join((t or "").lower() for t in texts) + sep
    u = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lens = np.fromiter((len((t or "").lower()) for t in texts), np.int64, len(texts))
    starts = len(sep) + np.concatenate([[0], np.cumsum(lens + len(sep))[:-1]]) if len(texts) else np.zeros(0, np.int64)
    space = (u == 32) | ((u >= 9) & (u <= 13))
    v = np.where(space, np.uint64(32), u.astype(np.uint64))
    doc = np.zeros(len(u), np.int32)
    if len(texts) > 1:
        doc[starts[1:] - len(sep)] = 1
        doc = np.cumsum(doc, dtype=np.int32)
    gap = np.concatenate([[0], np.cumsum(space)])
    h, out = v.copy(), []
    base = np.uint64(1_000_003)
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * base + v[n - 1 :]
        if n not in ORDERS:
            continue
        # No white space strictly inside; it may stand at either end, as the mark of a word's end.
        inside = gap[n - 1 : n - 1 + len(h)] - gap[1 : 1 + len(h)]
        at = np.flatnonzero(inside == 0)
        b = (mix(h[at] + np.uint64(n << 40)) >> np.uint64(64 - BITS)).astype(np.int64)
        if keep is not None:
            hit, b = keep.number(b)
            at = at[hit]
        out.append((doc[at].astype(np.uint64) << np.uint64(BITS)) | b.astype(np.uint64))
    pairs = np.unique(np.concatenate(out))
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


_COUNTS = pa.schema([("hash", pa.int64()), ("toxic", pa.int64()), ("other", pa.int64())])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted values, and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold an n-gram, added up in steps; hash -1 counts the texts."""
    held: dict[int, list[np.ndarray]] = {1: [], 0: []}

    def flush() -> Iterator[pa.RecordBatch]:
        for k in (1, 0):
            names, n = _runs(np.sort(np.concatenate([np.zeros(0, np.int64), *held[k]])))
            for i in range(0, len(names), 200_000):
                own, none = pa.array(n[i : i + 200_000]), pa.array(np.zeros(len(names[i : i + 200_000]), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 200_000]), own if k else none, none if k else own], schema=_COUNTS)
            held[k].clear()

    for b in steps(batches, limit=1 << 18):
        y = np.asarray(column(b, "toxic"), np.int64)
        rows, grams = presence(column(b, "text").to_pylist())
        for k in (1, 0):
            held[k] += [grams[(y == k)[rows]], np.full(int((y == k).sum()), -1, np.int64)]
        if sum(map(len, held[1] + held[0])) > 3_000_000:
            yield from flush()
    yield from flush()
    give_back()


class Model:
    def __init__(self, prior: float, keep: Features | None = None, weights: np.ndarray | None = None, bias: float = 0.0):
        self.prior, self.keep, self.weights, self.bias = prior, keep, weights, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.keep is None:
            return np.full(len(texts), self.prior)
        rows, cols = presence(texts, self.keep)
        z = np.bincount(rows, self.weights[cols], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on the whole sample; L2 on the weights. Entries (rows, cols), in order of rows, have the
    value scale[col], so values are never laid out; entries are held twice as 32-bit numbers, by row and by column."""
    n, d = len(y), len(scale)
    by_col = np.argsort(cols, kind="stable").astype(np.int32)
    rows_by_col = rows[by_col]
    row_start, col_start = np.searchsorted(rows, np.arange(n + 1)), np.searchsorted(cols[by_col], np.arange(d + 1))
    del by_col

    def sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
        out, full = np.zeros(len(start) - 1), np.flatnonzero(np.diff(start))
        if len(full):
            out[full] = np.add.reduceat(values, start[full])
        return out

    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, rounds + 1):
        z = sums((w[:d] * scale).astype(np.float32)[cols], row_start) + w[d]
        e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        g = np.concatenate([scale * sums(e.astype(np.float32)[rows_by_col], col_start) + l2 * w[:d], [e.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:d], float(w[d])


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model of rows (doc_id, text, toxic); rows without a label 0 or 1 are left out."""
    rows = labelled.where(F.col("toxic").isin(0, 1)).select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", "text").alias("h"))
    # The bound is found from hashes alone; the texts under it, each once, are dealt to tasks of about a thousand rows.
    last = rows.select("h").distinct().orderBy("h").limit(max_rows).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return Model(0.5)
    sample = cut(rows.where(F.col("h") <= last).repartition(-(-max_rows // 1000), "h").dropDuplicates(["h", "toxic"]))
    counted = cut(sample.mapInArrow(_frequencies, "hash long, toxic long, other long").groupBy("hash").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")))
    texts = counted.where("hash = -1").first()
    n = np.asarray([texts["b"], texts["a"]])
    prior = float((n[1] + 0.5) / (n.sum() + 1))
    if not n.all():
        return Model(prior)
    a, b, t1, t0 = F.col("a").cast("double"), F.col("b").cast("double"), F.lit(float(n[1])), F.lit(float(n[0]))
    cross = a * (t0 - b) - b * (t1 - a)
    chi = (t0 + t1) * cross * cross / ((a + b) * (t0 + t1 - a - b) * t0 * t1)
    told = counted.where((F.col("hash") >= 0) & (a + b >= LEAST_TEXTS) & (a + b < t0 + t1)).where(chi > CHI_SQUARE).orderBy("hash")
    best, ta, tb = (np.asarray(told.toArrow().column(c)) for c in ("hash", "a", "b"))  # bounded by the sample
    ratio = np.log((ta + 1) / (n[1] + 2)) - np.log((tb + 1) / (n[0] + 2))
    shared, kind = labelled.sparkSession.sparkContext.broadcast(best), np.uint16 if len(best) <= 1 << 16 else np.uint32

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Features(shared.value)
        for x in steps(batches, limit=1 << 19):
            r, k = presence(column(x, "text").to_pylist(), mine)
            held = np.bincount(r, minlength=x.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"toxic": [column(x, "toxic").to_pylist()], "held": [held.tobytes()], "cols": [k.astype(kind).tobytes()]}, pa.schema([("toxic", pa.list_(pa.int32())), ("held", pa.binary()), ("cols", pa.binary())]))
        give_back()

    y, held, cols = [], [np.zeros(0, np.int32)], [np.zeros(0, kind)]
    got = sample.mapInArrow(gather, "toxic array<int>, held binary, cols binary").toArrow().to_batches()
    while got:
        for g in got.pop(0).to_pylist():
            held.append(np.frombuffer(g["held"], np.int32))  # features of each text
            cols.append(np.frombuffer(g["cols"], kind))
            y += g["toxic"]
    held, cols = np.concatenate(held), np.concatenate(cols).astype(np.int32)
    rows = np.repeat(np.arange(len(y), dtype=np.int32), held)
    w, bias = logistic(rows, cols, ratio, np.asarray(y, float))
    return Model(prior, Features(best), w * ratio, bias)


def score(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5) under ``names``; columns of these names are replaced."""
    source = docs.select(*[c for c in docs.columns if c not in names])
    best = None if model.keep is None else model.keep.hashes
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((model.prior, best, model.weights, model.bias)))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, best, weights, bias = pickle.loads(shared.value)
        m = Model(prior, None if best is None else Features(best), weights, bias)
        for b in steps(batches, text, 1 << 19):
            s = m.scores(column(b, text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, *names])
        give_back()

    schema = StructType([*source.schema.fields]).add(names[0], DoubleType()).add(names[1], IntegerType())
    return source.mapInArrow(run, schema)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents with the smallest id hashes, ``max_rows`` ids at most.

    Of several labels of a document the largest counts. The chosen labels are broadcast, being bounded, so that no
    text is shuffled.
    """
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
