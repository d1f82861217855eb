"""Secret scans: base patterns, and a linear-chain conditional random field over tokens decoded by Viterbi.

Tokens are the runs between white space. The field tags them begin, inside or outside a secret; its features are the
shape class of a token (characters, length, entropy, keyword) and of the two before and the one after it, the words before
and after it (those of the training windows), and what kind of file the document is: whether it has keywords, long tokens
with digits, several assignments, many tokens with digits. It is trained on windows that hold everything that the base
patterns find in the training rows, and on windows from other rows; training rows are at most about ``MAX_ROWS`` (chosen by
hash; the same in every run). Of a decoded span the parts that no base span covers are added
with kind ``crf``; base spans always stay.

Offsets are code points, ends exclusive, over whole texts. Null texts count as empty; empty texts have no span. Repeated
rows get equal results; other columns pass, and columns of the names that a function adds are replaced. Without any base span to learn
from, only base spans are found. Empty tables give empty ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import column, give_back, steps

#: The base patterns, in their order of listing: kind, pattern, group to measure and its least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
KINDS = ("assign", "access", "hex", "crf")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Rows that training looks at, at most (expected number; chosen by hash), and tokens of a window.
MAX_ROWS = 20_000
WINDOW = 40
#: Bytes of text that a scan takes on at once (its arrays take some thirty times as much), and tokens whose classes it keeps.
SCAN_BYTES = 1 << 20
MAX_SHAPES = 100_000
B, I, O = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then in their order of listing."""
    found, low = [], text.lower()
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign" and not any(w in low for w in _WORDS):
            continue
        if kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(found)]


def _entropy(w: str) -> float:
    n = len(w)
    return -sum(c / n * math.log2(c / n) for c in (w.count(x) for x in set(w)))


_KEY = re.compile(r"(?i)pass(word|wd|phrase)?|secret|token|api|key|auth|credential|bearer|private")
_STEMS = ("pass", "secret", "token", "api", "key", "auth", "credential", "bearer", "private")
_LENGTHS = (1, 3, 7, 11, 15, 19, 23, 31, 47)
#: Marks around a token, and the entropy in bits that evenly spread characters exceed (a little over 3, for sums that round).
_EDGES = "\"'`()[]{}<>,;.!?"
_SPREAD = 3.0 + 1e-9
_FORMS = 14
CLASSES = _FORMS * (len(_LENGTHS) + 1) * 2


def shape(w: str) -> int:
    """Shape class of a token: form, length bucket, whether its characters are evenly spread."""
    body = w.strip(_EDGES)
    if not body:
        form = 0
    elif body in ("=", ":", ":=", "=>"):
        form = 1
    elif _KEY.search(body) and len(body) <= 24:
        form = 3 if body[-1] in "=:" else 4 if "=" in body or ":" in body else 2
    elif body.isdigit():
        form = 5
    elif not re.search(r"[0-9]", body):
        form = 6 if body.islower() else 7 if body.isupper() else 8 if body.istitle() else 9
    elif re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        form = 10
    elif re.fullmatch(r"[A-Z0-9]+", body):
        form = 11
    elif re.fullmatch(r"[A-Za-z0-9+/_=-]+", body):
        form = 12
    else:
        form = 13
    if form <= 4:  # marks and keywords are told apart by what they are, not by how long
        return form * (len(_LENGTHS) + 1) * 2
    size = sum(len(body) > x for x in _LENGTHS)
    return (form * (len(_LENGTHS) + 1) + size) * 2 + int(len(body) >= 8 and _entropy(body) > _SPREAD)


def word(w: str) -> str:
    """A token as a neighbouring word: its letters in small, without marks around them; empty if it is none."""
    body = w.strip(_EDGES + ":=")
    return body.lower() if len(body) <= 24 and body.replace("_", "").replace("-", "").isalpha() else ""


#: What a character tells of its token, as bits: its case, ASCII digits, marks of assignment, then what it keeps a token from
#: being (digits only, small hex, capital hex, capitals and digits, characters of codes), marks around tokens, wrong case for a title.
_LOWER, _UPPER, _TITLE, _DIGIT, _ASSIGN, _NOT_DIGITS, _NOT_HEX, _NOT_HEX_UP, _NOT_CAPITALS, _NOT_CODE, _EDGE, _UNTITLED, _KNOWN = (1 << i for i in range(13))
_CASED = _LOWER | _UPPER | _TITLE
#: Tokens that one array step classifies, and the length from which a token goes by itself, so that the arrays stay small.
_BLOCK = 4096
_LONG = 256


def _traits(ch: str) -> int:
    up, code = ch.isupper(), ch.isascii() and ch.isalnum()
    has = (
        (_LOWER, ch.islower()),
        (_UPPER, up),
        (_TITLE, ch.istitle() and not up),
        (_DIGIT, ch in "0123456789"),
        (_ASSIGN, ch in "=:"),
        (_NOT_DIGITS, not ch.isdigit()),
        (_NOT_HEX, ch not in "0123456789abcdef"),
        (_NOT_HEX_UP, ch not in "0123456789ABCDEF"),
        (_NOT_CAPITALS, not (code and (up or ch.isdigit()))),
        (_NOT_CODE, not (code or ch in "+/_=-")),
        (_EDGE, ch in _EDGES or ch == "\n"),
    )
    return sum(bit for bit, yes in has if yes) | _KNOWN


class _Traits:
    """Bits of code points; those of a code point are found when it first comes up."""

    def __init__(self) -> None:
        self.of = np.zeros(0x110000, np.uint16)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        bits = self.of.take(points)
        if not bits.all():
            for x in np.unique(points[bits == 0]).tolist():
                self.of[x] = _traits(chr(x))
            bits = self.of.take(points)
        return bits


def _keys(text: str) -> list[int]:
    """Where ``_KEY`` is found. Its stems are sought in small letters, but with letters that ignoring case takes for others."""
    if any(c in text for c in "\u0130\u0131\u017f\u212a"):
        return [m.start() for m in _KEY.finditer(text)]
    out, low = [], text.lower()
    for stem in _STEMS:
        i = low.find(stem)
        while i >= 0:
            out.append(i)
            i = low.find(stem, i + 1)
    return out


def _classes(tokens: list[str], traits: _Traits) -> np.ndarray:
    """``shape`` of tokens without white space, all in the same array steps."""
    text = "\n".join([*tokens, ""])
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = np.flatnonzero(points == ord("\n"))
    start = np.append(0, stop[:-1] + 1)
    bits = traits(points)
    cased = bits & _CASED != 0
    after = np.zeros(len(bits), bool)  # whether a character follows a cased one
    after[1:] = cased[:-1]
    bits |= (cased & ((bits & _LOWER != 0) != after)) * np.uint16(_UNTITLED)
    inner = bits & _EDGE == 0
    count, spots = np.cumsum(inner), np.append(np.flatnonzero(inner), 0)
    head, tail = count[start] - inner[start], count[stop]
    some = tail > head
    s, e = np.where(some, spots[head], start), np.where(some, spots[tail - 1], start) + 1
    size = e - s
    has = np.bitwise_or.reduceat(bits, np.stack([s, e], 1).ravel())[::2]
    lacks = lambda bit: has & bit == 0
    form = np.full(len(tokens), 13)
    form[lacks(_NOT_CODE)] = 12
    form[lacks(_NOT_CAPITALS)] = 11
    form[lacks(_NOT_HEX) | lacks(_NOT_HEX_UP)] = 10
    case = np.where(lacks(_CASED) | ~lacks(_UNTITLED), 9, 8)
    case[~lacks(_UPPER) & lacks(_LOWER | _TITLE)] = 7
    case[~lacks(_LOWER) & lacks(_UPPER | _TITLE)] = 6
    form = np.where(lacks(_DIGIT), case, form)
    form[lacks(_NOT_DIGITS)] = 5
    key = np.zeros(len(tokens), bool)
    key[np.searchsorted(stop, _keys(text))] = True
    key &= size <= 24
    ends = (points[e - 1] == ord("=")) | (points[e - 1] == ord(":"))
    form[key] = np.where(ends, 3, np.where(lacks(_ASSIGN), 2, 4))[key]
    form[(size == 1) & ends | (size == 2) & (points[s] == ord(":")) & (points[e - 1] == ord("="))] = 1
    form[~some] = 0
    spread = np.zeros(len(tokens), np.int64)
    if len(rows := np.flatnonzero((form > 4) & (size > 8))):  # eight characters have three bits at most
        m = size[rows]
        own = np.repeat(np.arange(len(rows)), m)
        pairs = own << 21 | points[np.repeat(s[rows] - np.cumsum(m) + m, m) + np.arange(len(own))]
        pairs.sort()
        runs = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        c = np.diff(np.append(runs, len(pairs)))
        spread[rows] = np.log2(m) - np.bincount(pairs[runs] >> 21, c * np.log2(c)) / m > _SPREAD
    per = len(_LENGTHS) + 1
    return np.where(form <= 4, form * per * 2, (form * per + np.searchsorted(_LENGTHS, size)) * 2 + spread)


class Shapes:
    """Tokens to their classes times ``wide`` plus the number of their word (0 for other words). Those of tokens are kept,
    bounded; new ones are found many at once."""

    def __init__(self, model: dict | None = None):
        self.words = {} if model is None else {w: i + 1 for i, w in enumerate(model["words"])}
        self.wide = len(self.words) + 1
        self.kept: dict[str, int] = {}
        self.traits = _Traits()

    def _found(self, tokens: list[str]) -> list[int]:
        long = np.flatnonzero(np.fromiter(map(len, tokens), np.int64, len(tokens)) > _LONG).tolist()
        short = tokens
        if long:
            short = tokens.copy()
            for i in long:
                short[i] = "."
        out = np.concatenate([_classes(short[i : i + _BLOCK], self.traits) for i in range(0, len(short), _BLOCK)])
        for i in long:
            out[i] = shape(tokens[i])
        out *= self.wide
        if self.words:
            number, marks = self.words.get, _EDGES + ":="
            v = np.fromiter([number(w.strip(marks).lower(), 0) for w in tokens], np.int64, len(tokens))
            for i in np.flatnonzero(v).tolist():
                if not tokens[i].isascii() and not word(tokens[i]):  # small letters of a word, but itself none
                    v[i] = 0
            out += v
        return out.tolist()

    def of(self, tokens: list[str]) -> np.ndarray:
        parts, most = [np.zeros(0, np.int64)], MAX_SHAPES // 2
        for i in range(0, len(tokens), most):
            some = tokens[i : i + most]
            got = list(map(self.kept.get, some))
            if None in got:
                gaps = [j for j, c in enumerate(got) if c is None]
                new = list({some[j] for j in gaps})
                if len(self.kept) + len(new) > MAX_SHAPES:
                    self.kept.clear()
                fresh = dict(zip(new, self._found(new), strict=True))
                for j in gaps:
                    got[j] = fresh[some[j]]
                self.kept.update(fresh)
            parts.append(np.array(got, np.int64))
        return np.concatenate(parts)


#: Kinds of files that are told apart.
FILES = 16


def file_kinds(classes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """What each document is, from its tokens' classes; documents begin at ``start`` and have a token."""
    form, size = classes // 2 // (len(_LENGTHS) + 1), classes // 2 % (len(_LENGTHS) + 1)
    some = lambda f: np.add.reduceat(f.astype(np.int64), start)
    key, assigned, digits = some((form >= 2) & (form <= 4)) > 0, some((form == 1) | (form == 3) | (form == 4)) >= 3, some((form == 5) | (form >= 10))
    n = np.diff(np.append(start, len(classes)))
    return key + 2 * (some((form >= 10) & (size >= 5)) > 0) + 4 * assigned + 8 * (10 * digits > n)


def neighbour(x: np.ndarray, k: int, start: np.ndarray, outside: int) -> np.ndarray:
    """The values k places on, in a stream of documents that begin at ``start``; ``outside`` beyond their ends."""
    out = np.full(len(x), outside, np.int64)
    if k < 0:
        out[-k:] = x[:k]
        for j in range(-k):
            s = start + j
            out[s[s < len(x)]] = outside
    else:
        out[:-k] = x[k:]
        out[(start - 1)[start > 0]] = outside
    return out


def emissions(model: dict, cls: np.ndarray, words: np.ndarray, files: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Scores (tokens, 3) of a stream; features don't cross the starts of documents."""
    u, w = model["u"], model["w"]
    shapes = u[0][cls] + u[1][neighbour(cls, -1, start, CLASSES)] + u[2][neighbour(cls, -2, start, CLASSES)] + u[3][neighbour(cls, 1, start, CLASSES)]
    return shapes + w[0][neighbour(words, -1, start, 0)] + w[1][neighbour(words, 1, start, 0)] + model["d"][files]


def viterbi(e: np.ndarray, trans: np.ndarray, begin: np.ndarray, start: np.ndarray, width: int = 256) -> np.ndarray:
    """Best labels of a stream of sequences that begin at ``start``.

    The stream is cut into chunks; each is solved for every label it may be entered with, all chunks at once, then the
    chunks are chained and traced back. Exact, with the work of a few array steps for each position of a chunk.
    """
    n, k = e.shape
    c = -(-n // width)
    pad = np.zeros((c * width, k))
    pad[:n] = e
    first = np.zeros(c * width, bool)
    first[start] = True
    first[n:] = True  # what fills up the last chunk is a sequence of its own
    pad, first = np.ascontiguousarray(pad.reshape(c, width, k).transpose(1, 2, 0)), first.reshape(c, width)
    score = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[:, :, None].repeat(c, 2)  # label before, entered with, chunk
    back = np.zeros((width, k, k, c), np.int8)  # label, entered with, chunk
    for t in range(width):
        free = score[:, None] + trans[:, :, None, None]
        if len(f := np.flatnonzero(first[:, t])):
            free[..., f] = score[:, None, :, f] + begin[:, None, None]
        top, best = free[0], back[t]
        for i in range(1, k):  # of equal ones the first
            np.copyto(best, i, where=free[i] > top, casting="unsafe")
            top = np.maximum(top, free[i])
        score = top + pad[t, :, None]
    score = score.transpose(2, 1, 0).copy()
    enter, total = np.zeros(c, np.int64), np.zeros(k)
    came = np.zeros((c, k), np.int64)
    for i in range(c):
        s = total[:, None] + score[i]
        came[i] = s.argmax(0)
        total = s.max(0)
        total -= total.max()
    leave = np.zeros(c, np.int64)
    last = int(total.argmax())
    for i in range(c - 1, -1, -1):
        leave[i] = last
        enter[i] = last = came[i][last]
    out, label, rows = np.zeros((c, width), np.int8), leave, np.arange(c)
    for t in range(width - 1, -1, -1):
        out[:, t] = label
        label = back[t, label, enter, rows].astype(np.int64)
    return out.reshape(-1)[:n]


def train(x: np.ndarray, v: np.ndarray, d: np.ndarray, y: np.ndarray, words: int, rounds: int = 120, l2: float = 1e-4) -> dict:
    """Fits the field to windows by Adam on the exact log likelihood. x (classes), v (words' numbers), y (labels):
    (windows, WINDOW), d (kinds of files): (windows,). Word 0 has no weight.

    Labels of padding are -1; padding lies at the end.
    """
    n, t_len = x.shape
    real = y >= 0
    shift = lambda a, k, fill: np.pad(a, ((0, 0), (2, 2)), constant_values=fill)[:, 2 + k : 2 + k + t_len]
    cols = [x, shift(x, -1, CLASSES), shift(x, -2, CLASSES), shift(x, 1, CLASSES)]
    near = [shift(v, -1, 0), shift(v, 1, 0)]
    gold = np.eye(3)[np.maximum(y, 0)] * real[:, :, None]
    p = {"u": np.zeros((4, CLASSES + 1, 3)), "w": np.zeros((2, words + 1, 3)), "d": np.zeros((FILES, 3)), "t": np.zeros((3, 3)), "b": np.zeros(3)}
    m, s = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    def by(c: np.ndarray, diff: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(c.ravel(), diff[:, :, k].ravel(), size) for k in range(3)], 1)

    for r in range(1, rounds + 1):
        e = sum(p["u"][i][c] for i, c in enumerate(cols)) + sum(p["w"][i][c] for i, c in enumerate(near)) + p["d"][d][:, None, :]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = p["b"] + e[:, 0]
        for t in range(1, t_len):
            step = lse(alpha[:, t - 1][:, :, None] + p["t"], 1) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], step, alpha[:, t - 1])
        for t in range(t_len - 2, -1, -1):
            step = lse(p["t"] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(real[:, t + 1, None], step, 0)
        z = lse(alpha[:, -1], 1)
        mark = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
        diff = (mark - gold) / n
        g = {"u": np.stack([by(c, diff, CLASSES + 1) for c in cols]), "w": np.stack([by(c, diff, words + 1) for c in near]), "d": np.stack([np.bincount(d, diff[:, :, k].sum(1), FILES) for k in range(3)], 1), "b": diff[:, 0].sum(0)}
        g["w"][:, 0] = 0
        pair = np.zeros((3, 3))
        for t in range(1, t_len):
            q = np.exp(alpha[:, t - 1][:, :, None] + p["t"] + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
            pair += (q * real[:, t, None, None]).sum(0) - gold[:, t - 1].T @ gold[:, t]
        g["t"] = pair / n
        for k in p:
            g[k] = g[k] + l2 * p[k]
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * s[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - 0.2 * (m[k] / (1 - 0.9**r)) / (np.sqrt(s[k] / (1 - 0.999**r)) + 1e-8)
    return p


def token_labels(text: str) -> tuple[list[str], list[int]]:
    """Tokens with the labels that the base spans give them."""
    spans = base_spans(text)
    tokens, labels, at, before = [], [], 0, -1
    spans.sort()
    for m in re.finditer(r"\S+", text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        inside = next((k for k in range(at, len(spans)) if spans[k][0] < m.end() and spans[k][1] > m.start()), None) if spans else None
        tokens.append(m.group())
        if inside is None:
            labels.append(O)
            before = -1
        else:
            labels.append(I if before >= 0 and spans[inside][0] < m.start() else B)
            before = inside
    return tokens, labels


def _other_value(c: int, draw: int) -> int:
    """Another class for a value of 8 characters or more with evenly spread characters; other classes stay."""
    per = len(_LENGTHS) + 1
    form, size = c // 2 // per, c // 2 % per
    if form < 10 or size < 3 or not c % 2:
        return c
    return ((10 + draw % 4) * per + 3 + draw // 4 % (per - 3)) * 2 + 1


def places(hits: list[int], back: int) -> list[int]:
    """Starts of windows that together hold all hits; each window begins ``back`` tokens before the first hit that the one
    before it does not hold."""
    out, end = [], 0
    for i in hits:
        if not out or i >= end:
            out.append(max(0, i - back))
            end = out[-1] + WINDOW
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes, first = Shapes(), np.zeros(1, np.int64)
    kind = lambda c: int(file_kinds(c, first)[0])
    for b in steps(batches, limit=SCAN_BYTES):
        rows = []
        for h, text in zip(column(b, "h").to_pylist(), column(b, "text").to_pylist(), strict=True):
            tokens, labels = token_labels(text)
            if not tokens:
                continue
            cls = shapes.of(tokens)
            hits = [i for i, y in enumerate(labels) if y == B]
            spots = places(hits, h % 20) or ([h % len(tokens)] if h % 8 == 0 else [])
            for i in spots:
                x, y, v = cls[i : i + WINDOW].tolist(), labels[i : i + WINDOW], list(map(word, tokens[i : i + WINDOW]))
                fill = WINDOW - len(x)
                rows.append((kind(cls), x + [CLASSES] * fill, v + [""] * fill, y + [-1] * fill))
                for k in range(3 if hits else 0):  # the same places with values of other shapes, so that the field isn't bound to those that the patterns know
                    other = [_other_value(c, h + 7 * k + j) if z != O else c for j, (c, z) in enumerate(zip(x, y, strict=True))]
                    rows.append((kind(np.asarray(other)), other + [CLASSES] * fill, v + [""] * fill, y + [-1] * fill))
        if rows:
            d, x, v, y = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"d": d, "x": x, "v": v, "y": y}, pa.schema([("d", pa.int32()), ("x", pa.list_(pa.int32())), ("v", pa.list_(pa.string())), ("y", pa.list_(pa.int32()))]))
    del shapes
    give_back()


def fit(docs: DataFrame, text: str = "text", max_rows: int = MAX_ROWS) -> dict | None:
    """The field trained on about ``max_rows`` rows at most; None where those hold no base span."""
    n = docs.count()
    h = F.shiftrightunsigned(F.xxhash64("doc_id", text), 34)
    rows = docs.select(F.col(text).alias("text"), h.alias("h")).where("text is not null").where(F.col("h") < int((1 << 30) * min(1.0, max_rows / max(1, n))))
    got = rows.mapInArrow(_windows, "d int, x array<int>, v array<string>, y array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return None
    x, y = (np.asarray(got.column(c).combine_chunks().flatten(), np.int64).reshape(-1, WINDOW) for c in ("x", "y"))
    if not (y == B).any():
        return None
    named = got.column("v").combine_chunks().flatten().dictionary_encode()
    words = sorted(w for w in named.dictionary.to_pylist() if w)
    number = {w: i + 1 for i, w in enumerate(words)}
    v = np.asarray([number.get(w, 0) for w in named.dictionary.to_pylist()], np.int64)[np.asarray(named.indices, np.int64)].reshape(-1, WINDOW)
    d = np.asarray(got.column("d"), np.int64)
    order = np.lexsort((v.sum(1), x[:, 0], d, x.sum(1)))  # sums don't depend on the order of tasks
    return train(x[order], v[order], d[order], y[order], len(words)) | {"words": words}


def uncovered(text: str, start: int, end: int, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The parts of a decoded span that base spans leave, without white space at their ends; parts of nothing but quotes,
    brackets, commas and semicolons are no secret's. base is in order of start."""
    out, at = [], start
    for s, e, _ in [*base, (end, end, "")]:
        s, e = min(s, end), min(e, end)
        if s > at and (rest := text[at:s]).strip("\"'`()[]{}<>,; \t\r\n"):
            left = at + len(rest) - len(rest.lstrip())
            out.append((left, left + len(rest.strip()), "crf"))
        at = max(at, e)
    return out


def scan_texts(model: dict | None, texts: list[str], shapes: Shapes) -> list[list[tuple[int, int, str]]]:
    """All spans of whole texts, by start and then by kind."""
    found = [base_spans(t) for t in texts]
    if model is None:
        return found
    lists = [t.split() for t in texts]
    full = [i for i, x in enumerate(lists) if x]
    if not full:
        return found
    cls, words = np.divmod(shapes.of([w for i in full for w in lists[i]]), shapes.wide)
    n = np.asarray([len(lists[i]) for i in full])
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    best = viterbi(emissions(model, cls, words, np.repeat(file_kinds(cls, start), n), start), model["t"], model["b"], start)
    hit = np.logical_or.reduceat(best == B, start)
    for j in np.flatnonzero(hit):
        i, labels = full[j], best[start[j] : start[j] + n[j]]
        at = [(m.start(), m.end()) for m in re.finditer(r"\S+", texts[i])]
        base, k, more = found[i], 0, []
        while k < len(labels):
            if labels[k] == B:
                z = k
                while z + 1 < len(labels) and labels[z + 1] == I:
                    z += 1
                s, e = at[k][0], at[z][1]
                more += uncovered(texts[i], s, e, base)
                k = z
            k += 1
        if more:
            found[i] = sorted(base + more, key=lambda r: (r[0], KINDS.index(r[2])))
    return found


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans; columns of these names are replaced."""
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    source = docs.select(*[c for c in docs.columns if c not in names])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shapes = shared.value, Shapes(shared.value)
        for b in steps(batches, text, SCAN_BYTES):
            every = scan_texts(m, [t or "" for t in column(b, text).to_pylist()], shapes)
            base = [[s for s in x if s[2] != "crf"] for x in every]
            cols = [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in KINDS[:3]]
            cols += [pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]), pa.array([joined(x) for x in every])]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])
        del shapes
        give_back()

    schema = StructType([*source.schema.fields])
    for c in names:
        schema = schema.add(c, LongType() if c.startswith("n_") else StringType())
    return source.mapInArrow(run, schema)


def redact(docs: DataFrame, model: dict | None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in the text replaced by ``mark``; null texts stay null."""
    source, shared = docs, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, shapes = shared.value, Shapes(shared.value)
        for b in steps(batches, text, SCAN_BYTES):
            texts, out = column(b, text).to_pylist(), []
            for t, spans in zip(texts, scan_texts(m, [t or "" for t in texts], shapes), strict=True):
                if spans:
                    parts, at = [], 0
                    for s, e, _ in spans:
                        if e > at:
                            if s >= at:
                                parts += [t[at:s], mark]
                            at = e
                    t = "".join(parts) + t[at:]
                out.append(t)
            k = b.schema.get_field_index(text)
            yield b.set_column(k, b.schema.field(k), pa.array(out, b.schema.field(k).type))
        del shapes
        give_back()

    return source.mapInArrow(run, source.schema)
