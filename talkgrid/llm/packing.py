"""Packing of tokenised documents into sequences of bounded length, by order-preserving dynamic programming.

Documents keep their order. A stream of them is cut into windows of at most ``size`` tokens; cuts may lie at a
document's end (free), at a sentence's end (a small penalty), or, in a stretch without either, inside a sentence (a
large one). A window costs its padding plus the penalty of its cut; a window of exactly half of ``size`` tokens, which needs
no padding, costs its cut alone (shorter powers of two would do as well, but make too many sequences). For other window
lengths the cost is linear in the start, so the best start of every cut is the head of a monotone queue; windows of half
the size are a second transition, found by position. Within a block of ``BLOCK`` tokens the cuts are the cheapest of this
cost; blocks follow each other, the last four windows of each being cut anew with the next, so over a whole
partition the sum is near the least, not proven to be it.

Every task packs the rows of its own partition, so nothing is shuffled and a lost task gives the same rows again;
only a partition's last window may be short for want of rows. Null and empty texts are a document of the end mark alone.
Repeated rows are packed each; null ids stay null. An empty table gives no rows. Other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import column, give_back, steps

SIZE = 2048
END_ID = 1
#: Costs, in padding tokens: of a cut inside a document at a sentence's end, and inside a sentence.
SENTENCE, INSIDE = 6, 40
#: Tokens after which a stretch without sentence ends gets places to cut, so many tokens apart.
STRETCH = 128
#: Tokens that are packed at once.
BLOCK = 1 << 18
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Stand in the stream of 16-bit ids behind a sentence's last chunk and behind a document; the vocabulary is smaller.
_STOP, _DONE = 65535, 65534


class Encoder:
    """Token ids of whole texts, with the tokenizer's own results kept for each space-separated chunk.

    No token of this tokenizer spans a space or a line end, so a text's ids are those of its chunks in turn, and only
    chunks not seen before reach the tokenizer. A chunk of letters with plain marks behind them is its word and then
    the marks; new words go to the tokenizer together, as one text, and are told apart by its word ends.
    """

    MARKS = ".,!?;:"
    END = "\n"  # stands for a document's end: no chunk has a line end

    def __init__(self, path: str, limit: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        if max(vocab.values()) >= _DONE:
            raise ValueError("the vocabulary does not fit 16 bits")
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, Split(" ", "removed")
        self.ids: dict[str, bytes] = {}
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.ids.clear()
        give_back()
        self.ids[self.END] = np.asarray([END_ID, _DONE], "<u2").tobytes()

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u2").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str], tok) -> None:
        for i in range(0, len(words), 2048):
            part = words[i : i + 2048]
            ids = np.asarray(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u2")
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * 2).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                self.ids.update(zip(part, [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)], strict=True))
            else:  # some word is several for the tokenizer
                self.ids.update(zip(part, self._each(part), strict=True))

    def _learn(self, new: set[str]) -> None:
        ids, stop = self.ids, np.asarray([_STOP], "<u2").tobytes()
        words = set(filter(str.isalpha, new))
        pairs, other = [], []
        for c in new - words:
            w = c.rstrip(self.MARKS)
            if w.isalpha():
                pairs.append((c, w, c[len(w) :]))
            else:
                other.append(c)
        words.update([w for _, w, _ in pairs])
        words = words.difference(ids)
        # Small ASCII letters need none of the tokenizer's normalising and splitting.
        self._learn_words([w for w in words if w.isascii() and w.islower()], self.bare)
        self._learn_words([w for w in words if not (w.isascii() and w.islower())], self.tok)
        marks = list({m for _, _, m in pairs})
        tails = {m: x + (stop if m[-1] in ".!?" else b"") for m, x in zip(marks, self._each(marks), strict=True)}
        for c, w, m in pairs:
            ids[c] = ids[w] + tails[m]
        for c, x in zip(other, self._each(other), strict=True):
            ids[c] = x + (stop if c[-1:] in (".", "!", "?") else b"")

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text: its ids with the end mark, and the positions after sentence ends (that of the document left out)."""
        if not texts:
            return []
        chunks: list = []
        for t in texts:
            chunks += t.replace("\n", " ").split(" ")
            chunks.append(self.END)
        if len(self.ids) > self.limit:
            self._clear()
        if new := set(chunks).difference(self.ids):
            self._learn(new)
        raw = np.frombuffer(b"".join(map(self.ids.__getitem__, chunks)), "<u2")
        stop, done = raw == _STOP, raw == _DONE
        real = ~(stop | done)
        ids, at = raw[real].astype("<u4"), np.cumsum(real)
        bounds = np.concatenate([[0], at[done]]).tolist()
        stops = at[stop]
        cut_at = np.searchsorted(stops, bounds).tolist()
        out = []
        for k, (lo, hi) in enumerate(pairwise(bounds)):
            e = stops[cut_at[k] : cut_at[k + 1]] - lo
            out.append((ids[lo:hi], e[(e > 0) & (e < hi - lo)]))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process; a worker that is used again keeps what it has learned."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(places: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices of the chosen places, the last included, for windows that start at 0.

    places: rising positions, none further than ``size`` from the one before (or 0). Ties take the earliest start.
    """
    pos, pen = [0, *places.tolist()], [0, *penalty.tolist()]
    n = len(pos)
    best, came = [0.0] * n, [0] * n
    at = {p: i for i, p in enumerate(pos)}
    half = size // 2 if size & (size - 1) == 0 and size > 2 else 0
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # rising keys: best[i] + pos[i] is least at the head
    lookup = at.get
    for j in range(1, n):
        p = pos[j]
        low = p - size
        while pos[queue[0][1]] < low:
            queue.popleft()
        # padding: size - (p - pos[i]); so best[i] + pos[i] decides. A start later is a shorter window.
        key, i = queue[0]
        cost = key + size - p
        h = lookup(p - half) if half else None
        if h is not None and best[h] < cost:
            cost, i = best[h], h
        cost += pen[j]
        best[j], came[j] = cost, i
        key = cost + p
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    out, j = [], n - 1
    while j:
        out.append(j - 1)
        j = came[j]
    return out[::-1]


class Packer:
    """Packs a stream of documents; holds about a block of tokens."""

    def __init__(self, first_sequence: int, size: int = SIZE, block: int = BLOCK):
        self.next_sequence, self.size, self.block = first_sequence, size, block
        self.docs: list[list] = []  # doc_id, ids, sentence ends, tokens already packed
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, ends, 0])
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.pack(final=False)

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        where, cost, base = [], [], 0
        for _, ids, ends, done in self.docs:
            e = ends[ends > done] - done
            n = len(ids) - done
            where += [e + base, [base + n]]
            cost += [np.full(len(e), SENTENCE), [0]]
            base += n
        where, cost = np.concatenate(where).astype(np.int64), np.concatenate(cost)
        gap = np.diff(where, prepend=0)
        more = [np.arange(where[i] - gap[i] + STRETCH, where[i], STRETCH) for i in np.flatnonzero(gap > STRETCH)]
        if more:
            extra = np.concatenate(more)
            where, cost = np.concatenate([where, extra]), np.concatenate([cost, np.full(len(extra), INSIDE)])
            order = np.argsort(where, kind="stable")
            where, cost = where[order], cost[order]
        return where, cost

    def pack(self, final: bool) -> Iterator[tuple]:
        """Pieces of the windows that are settled: all of them at the end, otherwise all but the last four."""
        if not self.docs:
            return
        where, cost = self._places()
        ends = where[cuts(where, cost, self.size)].tolist()
        if not final:
            ends = ends[:-4]
        d, at, used = 0, 0, 0
        for end in ends:
            offset = 0
            while at < end:
                doc_id, ids, _, done = doc = self.docs[d]
                n = min(len(ids) - done, end - at)
                yield doc_id, done, n, zlib.crc32(ids[done : done + n]), len(ids), self.next_sequence, offset
                doc[3] += n
                at, offset, used = at + n, offset + n, used + n
                if doc[3] == len(ids):
                    d += 1
            self.next_sequence += 1
        del self.docs[:d]
        self.held -= used


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, text: str = "text") -> DataFrame:
    """Pieces of all rows (doc_id, text); see PIECES. ``tokenizer``: path of word_bpe_49k.json, by default the installed one."""
    spec = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = str(public_tokenizers.path("word_bpe_49k.json"))
        give_back()  # what earlier stages left in this worker
        own = encoder(path)
        packer = Packer(TaskContext.get().partitionId() << 40, size)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=spec)

        for b in steps(batches, text, 1 << 20):
            rows = []
            ids, texts = column(b, "doc_id").to_pylist(), [t or "" for t in column(b, text).to_pylist()]
            for doc_id, (tokens, ends) in zip(ids, own.encode(texts), strict=True):
                rows += packer.add(doc_id, tokens, ends)
            if rows:
                yield batch(rows)
            give_back()
        if rows := list(packer.pack(final=True)):
            yield batch(rows)
        give_back()

    return docs.select("doc_id", text).mapInArrow(run, PIECES)
