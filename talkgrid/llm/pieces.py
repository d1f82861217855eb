"""SentencePiece encoding and decoding by suffix-array matching.

A batch's new words are put one after another and their suffixes sorted (by the longest piece's length). Every piece of
the vocabulary is found in that order by binary search, which gives all its occurrences; these are the edges of a
lattice. Edges are sorted by the position where they end and relaxed from left to right: a piece may follow the best
piece that ends where it starts if the two stay apart under the model's merges. For each position exactly one piece
passes, so what is found are the ids that the model's own merging gives.

Words are the model's: runs of the blank mark with what follows up to the next. No piece goes beyond one; words seen
before are looked up. Words are matched in groups of like length, however long they are. Only words that begin with
several blanks, of which pieces of blanks alone can be parts, are merged directly. Characters that the
vocabulary lacks become byte pieces.

Null and empty texts have no pieces and decode to an empty text. Repeated rows are encoded alike. Empty tables give empty
ones; other columns pass, but for one named ``piece_ids``, which :func:`encode_table` replaces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, steps

BLANK = "▁"
#: Words, and their characters, that are matched at once.
GROUP, GROUP_CHARS = 60_000, 1 << 20
_UNKNOWN, _BREAK = 65535, 0x110000
_CACHE_BITS = 20


class Pieces:
    """A model's pieces: strings, merge ranks and how each is made of two others."""

    def __init__(self, path: str, limit: int = 600_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)  # only the vocabulary is read from it
        self.size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(self.size)]
        self.byte0 = next(i for i in range(self.size) if model.is_byte(i))
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(BLANK in self.text[i].lstrip(BLANK) for i in plain):
            raise ValueError("a piece goes beyond a word")
        self.id = {self.text[i]: i for i in plain}
        score = {i: model.get_score(i) for i in plain}
        #: Rank of the merge that makes a piece: by score, best first.
        self.score = score
        order = sorted(plain, key=lambda i: (-score[i], i))
        self.rank = np.zeros(self.size + 1, np.int64)
        for r, i in enumerate(order):
            self.rank[i] = r + 1
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        usable, keys, made = [], [], []
        for i in plain:
            t = self.text[i]
            for k in range(1, len(t)):
                if (a := self.id.get(t[:k])) is not None and (b := self.id.get(t[k:])) is not None:
                    keys.append(a << 32 | b)
                    made.append(i)
            if len(t) == 1:
                usable.append(i)
                continue
            got = self._merge(t)
            if len(got) == 1 and got[0][0] == i:
                usable.append(i)
                self.left[i], self.right[i] = got[0][1:]
        by = np.argsort(keys)
        self.pair_keys, self.pair_made = np.asarray(keys, np.int64)[by], np.asarray(made, np.int64)[by]
        # Words with several blanks are merged directly, so pieces of several blanks are no edges.
        usable = [i for i in usable if BLANK * 2 not in self.text[i]]
        self.usable = np.asarray(usable, np.int64)
        self.length = np.asarray([len(t) for t in self.text] + [1], np.int64)
        self.longest = max(len(self.text[i]) for i in usable)
        self.codes = np.full((len(usable), self.longest), -1, np.int64)
        for row, i in enumerate(usable):
            self.codes[row, : len(self.text[i])] = [ord(c) for c in self.text[i]]
        self.words: dict[str, bytes] = {}
        self.limit = limit
        self.cache_key = np.full(1 << _CACHE_BITS, -1, np.int64)
        self.cache_ok = np.zeros(1 << _CACHE_BITS, bool)

    def _merge(self, t: str) -> list[tuple[int, int, int]]:
        """The model's merging: best score first, then leftmost. (piece or -1 - code point, left, right) of each symbol."""
        n = len(t)
        sym = [self.id.get(c, -1 - ord(c)) for c in t]
        parts = [(s, s) for s in sym]
        end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        live, heap = [True] * n, []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (m := self.id.get(t[i : end[j]])) is not None:
                heapq.heappush(heap, (-self.score[m], i, end[j], m))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, e, m = heapq.heappop(heap)
            j = nxt[i] if live[i] else n
            if j >= n or not live[i] or end[j] != e:
                continue
            parts[i] = sym[i], sym[j]
            sym[i], end[i], live[j] = m, e, False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        return [(sym[i], *parts[i]) for i in range(n) if live[i]]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging a's and b's text gives just a and b, for pairs of pieces: their outer parts are taken back
        merge by merge, and no pair met on the way may merge earlier than the piece it would break up."""
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a < self.size) & (b < self.size))
        x, y, top = a[at], b[at], np.full(len(at), 1 << 60)
        rank = self.rank
        while len(at):
            k = x << 32 | y
            i = np.minimum(np.searchsorted(self.pair_keys, k), len(self.pair_keys) - 1)
            bad = (self.pair_keys[i] == k) & (rank[self.pair_made[i]] < top)
            out[at[bad]] = False
            rx, ry = np.where(self.left[x] == x, 0, rank[x]), np.where(self.left[y] == y, 0, rank[y])
            go = ~bad & ((rx > 0) | (ry > 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            # Of the two the one made later is taken back; equal pieces are made left to right.
            first = rx > ry
            top = np.where(first, rx, ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`apart` through a table of pairs seen before."""
        key = a << 32 | b
        slot = (key * np.int64(-7046029254386353131) >> (64 - _CACHE_BITS)) & ((1 << _CACHE_BITS) - 1)
        ok = self.cache_ok[slot]
        miss = np.flatnonzero(self.cache_key[slot] != key)
        if len(miss):
            k, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            new = self.apart(a[miss][first], b[miss][first])
            ok[miss] = new[back]
            s = slot[miss][first]
            self.cache_key[s], self.cache_ok[s] = k, new
            # Two keys of one slot: the last one written is in both arrays only if order agrees, so check again.
            self.cache_key[s[self.cache_key[s] != k]] = -1
        return ok

    def suffixes(self, code: np.ndarray) -> np.ndarray:
        """Suffix order by the first ``longest`` characters, by doubling."""
        _, rank = np.unique(code, return_inverse=True)
        h = 1
        while h < self.longest:
            nxt = np.zeros_like(rank)
            nxt[:-h] = rank[h:] + 1
            _, rank = np.unique(rank * (len(code) + 2) + nxt, return_inverse=True)
            h *= 2
        return np.argsort(rank, kind="stable")

    def occurrences(self, code: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every usable piece the range of suffixes that begin with it."""
        n, m = len(order), len(self.usable)
        lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
        padded = np.concatenate([code, np.full(self.longest, -1)])
        for d in range(self.longest):
            at = np.flatnonzero((self.codes[:, d] >= 0) & (lo < hi))
            if not len(at):
                break
            c = self.codes[at, d]
            for upper in (False, True):
                a, b = lo[at].copy(), hi[at].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    v = padded[order[np.minimum(mid, n - 1)] + d]
                    right = open_ & ((v <= c) if upper else (v < c))
                    a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
                if upper:
                    hi[at] = a
                else:
                    first = a
            lo[at] = first
        return lo, np.maximum(lo, hi)

    def _match(self, words: list[str]) -> None:
        """Ids of new words without further blanks, by the lattice of all occurrences."""
        joined = "".join(f"{BLANK}{w}\0" for w in words)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        code[begin + size] = _BREAK
        order = self.suffixes(code)
        lo, hi = self.occurrences(code, order)
        n = hi - lo
        piece = np.repeat(self.usable, n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = order[np.repeat(lo, n) + inside]
        single = np.zeros(len(code), bool)
        single[start[self.length[piece] == 1]] = True
        other = np.flatnonzero(~single & (code != _BREAK))  # characters without a piece
        start, piece = np.concatenate([start, other]), np.concatenate([piece, np.full(len(other), self.size)])
        end = start + self.length[piece]
        word_of = np.repeat(np.arange(len(words)), size + 1)
        rel = end - begin[word_of[start]]
        by = np.lexsort((start, end, rel))  # where they end, longest first
        start, piece, end, rel = start[by], piece[by], end[by], rel[by]
        new = np.concatenate([[True], end[1:] != end[:-1]])
        turn = np.arange(len(end)) - np.maximum.accumulate(np.where(new, np.arange(len(end)), 0))
        best = np.full(len(code) + 1, -1, np.int64)
        first_of = np.zeros(len(code) + 1, bool)
        first_of[begin] = True
        bounds = np.searchsorted(rel, np.arange(1, int(rel.max()) + 2))
        for a, z in pairwise(bounds.tolist()):
            t = turn[a:z]
            for r in range(int(t.max()) + 1 if z > a else 0):
                at = a + np.flatnonzero(t == r)
                at = at[best[end[at]] < 0]
                s = start[at]
                ok = first_of[s]
                rest = np.flatnonzero(~ok & (best[s] >= 0))
                if len(rest):
                    ok[rest] = self.follows(best[s[rest]], piece[at[rest]])
                best[end[at[ok]]] = piece[at[ok]]
        # Trace back all words in step.
        where, live, found = begin + size, np.arange(len(words)), []
        broken = best[where] < 0
        live = live[~broken]
        while len(live):
            p = best[where[live]]
            where[live] -= self.length[p]
            found.append((live, p, where[live]))
            live = live[where[live] > begin[live]]
        if found:
            w, p, at = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.lexsort((at, w))
            w, p, at = w[by], p[by], at[by]
            wide = np.ones(len(p), np.int64)
            lost = np.flatnonzero(p == self.size)
            utf8 = [chr(c).encode("utf-8", "surrogatepass") for c in code[at[lost]].tolist()]
            wide[lost] = list(map(len, utf8))
            flat = np.repeat(p, wide)
            if len(lost):
                into = np.repeat((np.cumsum(wide) - wide)[lost], wide[lost])
                step = np.arange(len(into)) - np.repeat(np.cumsum(wide[lost]) - wide[lost], wide[lost])
                flat[into + step] = np.frombuffer(b"".join(utf8), np.uint8).astype(np.int64) + self.byte0
            raw = flat.astype("<u2").tobytes()
            ends = (np.bincount(w, wide, len(words)).cumsum() * 2).astype(np.int64).tolist()
            self.words.update({x: raw[a:b] for x, a, b in zip(words, [0, *ends], ends, strict=False)})
        for i in np.flatnonzero(broken):
            self._direct(words[i])

    def _direct(self, word: str) -> None:
        ids = []
        for s, _, _ in self._merge(BLANK + word):
            ids += [s] if s >= 0 else [self.byte0 + b for b in chr(-1 - s).encode("utf-8", "surrogatepass")]
        self.words[word] = np.asarray(ids, "<u2").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        lists = []
        for t in texts:
            if not t:
                lists.append([])
            elif BLANK in t or "  " in t or t[0] == " " or t[-1] == " ":
                lists.append([w[1:] for w in re.findall(f"{BLANK}+[^{BLANK}]*", BLANK + t.replace(" ", BLANK))])
            else:
                lists.append(t.split(" "))
        if len(self.words) > self.limit:
            self.words.clear()
        new = {w for x in lists for w in x if w not in self.words}
        simple = sorted((w for w in new if w and BLANK not in w), key=len)
        for w in new.difference(simple):
            self._direct(w)
        at, total = 0, np.cumsum(np.fromiter(map(len, simple), np.int64, len(simple)))
        while at < len(simple):
            most = int(total[at - 1] if at else 0) + GROUP_CHARS
            to = min(at + GROUP, max(at + 1, int(np.searchsorted(total, most, "right"))))
            self._match(simple[at:to])
            at = to
        get = self.words.__getitem__
        return [np.frombuffer(b"".join(map(get, x)), "<u2") for x in lists]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces joined as UTF-8 (what isn't valid becomes U+FFFD), the first blank dropped."""
        if not hasattr(self, "raw"):
            self.raw = [bytes([i - self.byte0]) if self.byte0 <= i < self.byte0 + 256 else b"" if i < self.byte0 and i not in self.id.values() else t.replace(BLANK, " ").encode() for i, t in enumerate(self.text)]
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_LOADED: dict[str, Pieces] = {}


def pieces(path: str | None = None) -> Pieces:
    """The pieces of a model file (by default the installed piece_bpe_32k.model), once for each process."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_table(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with the ids of the text as array column ``piece_ids``."""
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    source = docs.select(*[c for c in docs.columns if c != "piece_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in steps(batches, text, 2 << 20):
            ids = p.encode([t or "" for t in column(b, text).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))], names=[*b.schema.names, "piece_ids"])

    return source.mapInArrow(run, StructType([*source.schema.fields]).add("piece_ids", ArrayType(IntegerType())))


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: id, number of pieces, CRC-32 of the little-endian 32-bit ids, byte pieces,
    SHA-256 of the decoded text and whether that is the text."""
    spec = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("n_byte_pieces", pa.int64()), ("decoded_sha256", pa.string()), ("same_text", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in steps(batches, text, 2 << 20):
            texts, rows = [t or "" for t in column(b, text).to_pylist()], []
            for t, ids in zip(texts, p.encode(texts), strict=True):
                back = p.decode(ids)
                rows.append((len(ids), zlib.crc32(ids.astype("<u4")), int(((ids >= p.byte0) & (ids < p.byte0 + 256)).sum()), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == t))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(spec)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([column(b, id_col).cast(pa.int64()), *cols], schema=spec)

    return docs.select(id_col, text).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_byte_pieces long, decoded_sha256 string, same_text boolean")
