"""Language identification by word-first backoff.

Known words score by their log frequency in each language. An unseen word is covered from left to right by the
longest known character n-grams (5 down to 1, word ends marked), each adding its log frequency. The text's language
has the largest sum; its score is the posterior under equal priors. A tie goes to the smallest language name.

Text that is null, empty or without letters: language ``und``, score 0. Rows repeat as they come; other columns pass.
With nothing to learn from, every text is ``und``.

The counts come from a sample of labelled rows of at most about ``per_lang`` rows a language (a row is chosen by the
hash of its id and text, so the same rows are chosen in every run); all rows are predicted, over their whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, give_back, mix, steps

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: Labelled rows a language to learn from (expected number; chosen by hash).
PER_LANG = 1500


def grams(word: str) -> Iterator[str]:
    w = f"^{word}$"
    for n in ORDERS:
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = {}

    def flush():
        for lang, c in found.items():
            keys = list(c)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "word": keys, "n": [c[k] for k in keys]})
        found.clear()

    for b in steps(batches):
        for text, lang in zip(column(b, "text").to_pylist(), column(b, "lang").to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
        if sum(map(len, found.values())) > 200_000:
            yield from flush()
    yield from flush()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of (lang, word, n)."""
    for b in batches:
        found: dict[str, Counter] = {}
        for lang, word, n in zip(*(column(b, c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            c = found.setdefault(lang, Counter())
            for g in grams(word):
                c[g] += n
        for lang, c in found.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(c), "word": list(c), "n": list(c.values())})


def hashed(words) -> np.ndarray:
    """64-bit hashes of words."""
    words = list(words)
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def gram_hashes(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the hash of the n-gram that begins at each character of the texts in turn (some reach into the next
    text), and where texts begin and end."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    by_order, h = {}, np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        nxt = np.zeros(len(code), np.uint64)
        nxt[: len(code) - n + 1] = code[n - 1 :] if n <= len(code) else 0
        h = h * np.uint64(1_000_003) + nxt + np.uint64(1)
        by_order[n] = mix(h + np.uint64(n << 58))
    return [by_order[n] for n in ORDERS], end - size, end


def _places(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of hashes among sorted keys, -1 where they aren't there."""
    if not len(keys):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[i] == h, i, -1)


class Model:
    """Log frequencies of words and n-grams: sorted hashes and a matrix with one column a language. A worker holds it once, as
    plain arrays.

    words, gram_counts: for each language a mapping to counts; n-grams are counted from the words if not given.
    """

    def __init__(self, langs: list[str], words: dict[str, dict], gram_counts: dict[str, dict] | None = None, alpha: float = 0.5):
        self.langs = langs
        if gram_counts is None:
            gram_counts = {lang: Counter() for lang in words}
            for lang, c in words.items():
                for w, n in c.items():
                    for g in grams(w):
                        gram_counts[lang][g] += n
        #: word_known: whether a word occurs in a language.
        self.word_keys, self.word_logs, self.word_known = self._table(words, alpha)
        # Frequencies are those among n-grams of one length.
        parts = [self._table({lang: {g: k for g, k in c.items() if len(g) == n} for lang, c in gram_counts.items()}, alpha, n)[:2] for n in ORDERS]
        keys, logs = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(keys)
        self.gram_keys, self.gram_logs = keys[order], logs[order]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_shared"}

    def _table(self, counts: dict[str, dict], alpha: float, order: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names: dict[str, int] = {}
        for c in counts.values():
            for w in c:
                names.setdefault(w, len(names))
        m = np.zeros((len(names), len(self.langs)))
        for k, lang in enumerate(self.langs):
            c = counts.get(lang, {})
            m[np.fromiter(map(names.__getitem__, c), np.int64, len(c)), k] = np.fromiter(c.values(), float, len(c))
        if order:
            hashes, start, _ = gram_hashes(list(names))
            keys = hashes[ORDERS.index(order)][start]
        else:
            keys = hashed(names)
        by = np.argsort(keys)
        return keys[by], np.log((m + alpha) / (m.sum(0) + alpha * max(1, len(m))))[by], (m > 0)[by]

    def unseen(self, words: list[str]) -> np.ndarray:
        """For each word the sum over the longest known n-grams that cover it from left to right; what none covers adds nothing.
        All words go forward together."""
        total = np.zeros((len(words), len(self.langs)))
        if not words:
            return total
        hashes, at, end = gram_hashes([f"^{w}$" for w in words])
        left = np.repeat(end, end - at) - np.arange(end[-1])
        place, step = np.full(len(left), -1), np.ones(len(left), np.int64)
        for n, h in zip(ORDERS, hashes, strict=True):
            open_ = np.flatnonzero((place < 0) & (left >= n))
            found = _places(self.gram_keys, h[open_])
            hit = found >= 0
            place[open_[hit]], step[open_[hit]] = found[hit], n
        live = np.arange(len(words))
        while len(live):
            i = at[live]
            some = place[i] >= 0
            total[live[some]] += self.gram_logs[place[i[some]]]
            at[live] += step[i]
            live = live[at[live] < end[live]]
        return total


class _Scorer(dict):
    """Words met to rows of ``rows`` (their logs) and ``known``; forgets everything beyond ``limit`` words."""

    def __init__(self, model: Model, limit: int = 400_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.rows = np.zeros((4096, len(model.langs)))
        self.known = np.zeros(self.rows.shape, bool)

    def learn(self, words: set[str]) -> None:
        m = self.model
        if len(self) + len(words) > self.limit:
            self.clear()
        first, new = len(self), list(words)
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        at = np.arange(first, first + len(new))
        place = _places(m.word_keys, hashed(new))
        hit = place >= 0
        self.rows[at[hit]], self.known[at[hit]] = m.word_logs[place[hit]], m.word_known[place[hit]]
        self.known[at[~hit]] = False
        lost = np.flatnonzero(~hit)
        self.rows[at[lost]] = m.unseen([new[i] for i in lost.tolist()])
        self.update(zip(new, at.tolist(), strict=True))


def predict(model: Model, texts: list[str | None], scorer: _Scorer | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages and posteriors of whole texts, and the smoothed share of their words that the language is known to have:
    (known + 1) / (words + 1), 0 without words."""
    scorer = scorer if scorer is not None else _Scorer(model)
    lists = [WORD.findall(t.lower()) if t else [] for t in texts]
    sums = np.zeros((len(texts), len(model.langs)))
    # What counts as a word character may still be no letter (superscripts, say).
    full = [i for i, x in enumerate(lists) if any(w.isalpha() or any(map(str.isalpha, w)) for w in x)]
    if full and model.langs:
        if new := {w for i in full for w in lists[i] if w not in scorer}:
            scorer.learn(new)
            if missing := {w for i in full for w in lists[i] if w not in scorer}:  # forgotten to make room
                scorer.learn(missing)
        ids = np.fromiter(map(scorer.__getitem__, (w for i in full for w in lists[i])), np.int64)
        starts = np.concatenate([[0], np.cumsum([len(lists[i]) for i in full])[:-1]])
        sums[full] = np.add.reduceat(scorer.rows[ids], starts, axis=0)
    out, score, known = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if full and model.langs:
        s = sums[full]
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best, n = p.argmax(1), np.asarray([len(lists[i]) for i in full])
        score[full] = p.max(1)
        known[full] = (np.add.reduceat(scorer.known[ids, np.repeat(best, n)], starts, dtype=np.int64) + 1) / (n + 1)
        for i, k in zip(full, best.tolist(), strict=True):
            out[i] = model.langs[k]
    return out, score, known


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """The model of labelled rows (doc_id, text, lang); lang is not null."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], {})
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_lang / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share).select("text", "lang")
    counted = cut(sample.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))

    def known(table: DataFrame) -> dict[str, dict]:
        """Bounded by the sample."""
        out: dict[str, dict] = {}
        for b in table.select("lang", "word", "n").toArrow().to_batches():
            for lang, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.setdefault(lang, {})[w] = n
        return out

    in_words = counted.mapInArrow(_grams, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Model(langs, known(counted), known(in_words))


def least_known(labelled: DataFrame, model: Model) -> float:
    """A share of known words that no text of the model's languages should fall under: half of the lowest two in a
    thousand among labelled rows, which the model has not learned from. All of them count, and the place among them is exact;
    0 where there is none."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text")
    found = identify(rows, model, names=("lang_pred", "score", "known")).where("lang_pred <> 'und'")
    values = cut(found.groupBy("known").count())
    n = values.agg(F.sum("count").alias("n")).first()["n"]
    if not n:
        return 0.0
    place = -(-n // 500)  # so many rows have the value looked for or a lower one, so it is among as many lowest values
    upto = F.sum("count").over(Window.orderBy("known"))
    return 0.5 * values.orderBy("known").limit(place).withColumn("n", upto).where(F.col("n") >= place).agg(F.min("known").alias("k")).first()["k"]


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with language and score under ``names``, and the share of known words where there is a third name; columns
    of these names are replaced."""
    kept = [c for c in docs.columns if c not in names]
    shared = model.__dict__.pop("_shared", None) or docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    model._shared = shared  # one copy for all that the model is used for

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = _Scorer(m)
        for b in steps(batches, text, 1 << 20):
            langs, *numbers = predict(m, column(b, text).to_pylist(), scorer)
            added = [pa.array(langs, pa.string()), *map(pa.array, numbers)][: len(names)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *names])
        del scorer, m
        give_back()

    from pyspark.sql.types import DoubleType, StringType, StructType

    source = docs.select(*kept)
    schema = StructType([*source.schema.fields])
    for i, c in enumerate(names):
        schema = schema.add(c, DoubleType() if i else StringType())
    return source.mapInArrow(run, schema)


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` modulo ``mod``; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(True))
