"""The similarity join, fingerprints, archives and lossless pictures against brute force and round trips."""

import base64
import gzip
import hashlib
import io
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid.llm import fingerprint, graph, simjoin, warc, webp
from talkgrid.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent):
    sets, inverted = [], {}
    for i, (_, t) in enumerate(rows):
        w = WORD.findall((t or "").lower())
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.append(s)
        for x in s:
            inverted.setdefault(x, []).append(i)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in inverted[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                parent[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)], links[i]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 70)])
def test_similarity_join_is_exact(spark, k, percent):
    r, rows = random.Random(k), []
    words = [f"w{i}" for i in range(300)]
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 4, 8, 12, 15, 20, 30, 45, 60, 100, 200, 400]))]
        for _ in range(r.choice([1, 3, 12])):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                p, op = r.randrange(len(x) + 1), r.random()
                if op < 0.4 and x:
                    x[p - 1] = r.choice(words)
                elif op < 0.7:
                    x.insert(p, r.choice(words))
                elif x:
                    x.pop(p - 1)
            rows.append((len(rows), " ".join(x)))
    rows += [(len(rows), None), (len(rows) + 1, "")]
    # One group of many near copies, verified in several blocks.
    base = [f"b{i}" for i in range(150)]
    for _ in range(400):
        x = list(base)
        for _ in range(r.choice([1, 2, 3])):
            x[r.randrange(150)] = r.choice(words)
        rows.append((len(rows), " ".join(x)))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in simjoin.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(64)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def plain_form(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", t).strip(" ")


def test_canonical_forms_are_the_plain_ones(spark):
    rows = [(0, "a\x85b"), (1, "A\x1c \x1fB"), (2, "\u2003ﬁNE\u3000x\u2028"), (3, "Straße İ ΑΣ"), (4, ""), (5, "\x85"), (6, "e\u0301\xa0É")]
    got = dict(spark.createDataFrame(rows, "i long, text string").select("i", fingerprint.canonical(F.col("text")).alias("c")).collect())
    assert got == {i: plain_form(t) for i, t in rows}


def test_fingerprints_keep_columns_of_their_own_names(spark):
    df = spark.createDataFrame([(1, "a", "x", "y", "z", "w"), (2, "A ", "x", "y", "z", "w")], "doc_id long, text string, _form string, key string, digest string, row string")
    for compare in ("bytes", "digest"):
        out = fingerprint.fingerprint(df, compare=compare)
        assert out.columns == [*df.columns, "fingerprint"] and len({r.fingerprint for r in out.collect()}) == 1
        assert [tuple(r)[2:6] for r in out.collect()] == [("x", "y", "z", "w")] * 2


def test_edited_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = QUERIES["op10_fingerprint"](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    rows = docs.toPandas().sort_values("doc_id", ascending=False)
    texts, ids = rows.text.tolist(), rows.doc_id.tolist()
    for i, t in enumerate(texts):
        n, nxt = len(t), texts[(i + 1) % len(texts)]
        e = t[: n - n // 2] + nxt[: n // 2]
        r = out.loc[ids[i]]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(e.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(plain_form(e) == plain_form(t)), float(plain_form(nxt) == plain_form(t)))
    assert out.fingerprint.nunique() == len({re.sub(r"\s+", " ", t.casefold()).strip() for t in texts})


def test_fingerprints_of_colliding_buckets(spark):
    rows = [(i, f"Text  {i % 40}") for i in range(80)] + [(100, "ﬁne Café"), (101, " FINE café\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (4, 128):
        got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint(df, bits=bits).collect()}
        assert got[100] == got[101] and len(set(got.values())) == 41
        assert all(got[i] == got[i + 40] for i in range(40))


def test_native_plan_has_no_python(spark):
    plan = QUERIES["op10_fingerprint"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_archives(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    out = QUERIES["op4_warc"](spark, sf).toPandas().set_index("page_id")
    first = pages.groupby("html").page_id.min()
    for p, html in zip(pages.page_id, pages.html, strict=True):
        r = out.loc[p]
        data = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.record_type == ("response" if first[html] == p else "revisit")
        assert (r.refers_to == first[html]) if first[html] != p else np.isnan(r.refers_to)


def foreign_archive():
    """Records as other tools write them: uuid ids, a warcinfo, a chunked message, hexadecimal digests, folded lines."""
    body = b"<html>" + b"p" * 500
    http = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n" + body
    sent = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"
    rows = [
        (b"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:00000000-0000-4000-8000-000000000001>\r\nContent-Type: application/warc-fields", b"software: x\r\n"),
        (b"WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Target-URI:\r\n  http://a.example/\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(body).hexdigest().encode(), http),
        (b"warc-type: response\r\nWARC-Record-ID: <urn:uuid:3>\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"abc").digest()), sent),
        (b"WARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:4>\r\nContent-Type: text/plain", b""),
        (b"WARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:5>\r\nContent-Type: application/http\r\nWARC-Refers-To: <urn:uuid:2>\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()), b"HTTP/1.1 200 OK\r\n\r\n"),
    ]
    return [b"WARC/1.0\r\n" + h + b"\r\nContent-Length: %d\r\n\r\n" % len(d) + d + b"\r\n\r\n" for h, d in rows], body


@pytest.mark.parametrize("zipped", [True, False])
def test_archives_of_other_tools(spark, tmp_path, zipped):
    parts, body = foreign_archive()
    path = tmp_path / "x.warc"
    path.write_bytes(b"".join(map(gzip.compress, parts)) if zipped else b"".join(parts))
    read = warc.read_archives(spark.createDataFrame([(f"file://{path}",)], "archive string"), size=100)
    rows = {r.record_uri[-1]: r for r in warc.resolved(warc.records(read)).collect()}
    assert [rows[k].record_type for k in "12345"] == ["warcinfo", "response", "response", "resource", "revisit"]
    assert rows["2"].target_uri == "http://a.example/" and rows["2"].payload_bytes == len(body) == rows["5"].payload_bytes
    assert rows["5"].digest == rows["2"].digest == warc.b32(hashlib.sha1(body).digest()) and rows["4"].payload_bytes == 0
    data = read.where("record_uri like '%2'").orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data) for r in data) == body and len(data) == 6


def test_written_archives_are_standard_messages(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x y\r\nEvil: 1", "<p>é</p>"), (2, None, "<p>é</p>")], "page_id long, url string, html string")
    name = warc.archive_pages(pages, url="url").first().archive
    raw = gzip.decompress(open(name.removeprefix("file://"), "rb").read()).decode()
    assert "WARC-Target-URI: http://a.example/x%20y%0D%0AEvil:%201\r\n" in raw and "\r\n\r\nHTTP/1.1 200 OK\r\n" in raw
    assert raw.count("WARC/1.1\r\n") == 2 and "X-Payload" not in raw and "WARC-Type: revisit" in raw


def test_reader_streams_and_checks():
    rows = [{"record_id": i, "sha1": hashlib.sha1(d).hexdigest(), "payload_bytes": len(d), "record_type": "response", "refers_to": None, "data": d} for i, d in enumerate([b"", b"x" * 1000, bytes(range(256)) * 9])]
    raw = io.BytesIO()
    w = warc.ArchiveWriter(raw)
    for r in rows:
        n = max(1, -(-r["payload_bytes"] // 100))
        for k in range(n):
            w.add(r | {"chunk_no": k, "n_chunks": n, "data": r["data"][100 * k : 100 * k + 100]})
    got = list(warc.read_stream(io.BytesIO(raw.getvalue()), 64))
    for r in rows:
        mine = [g for g in got if g["record_id"] == r["record_id"]]
        assert b"".join(g["data"] for g in mine) == r["data"]
        assert [g["running_sha1"] for g in mine] == [warc.b32(hashlib.sha1(r["data"][: 64 * (k + 1)]).digest()) for k in range(len(mine))]
    plain = gzip.decompress(raw.getvalue())
    broken = gzip.compress(plain.replace(b"x" * 50, b"y" * 50, 1))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_stream(io.BytesIO(broken)))
    with pytest.raises(ValueError, match="truncated"):
        list(warc.read_stream(io.BytesIO(raw.getvalue()[:-20])))


def test_texts_survive_as_pictures():
    r = random.Random(3)
    texts = [b"", b"a", b"x" * 192, b"y" * 5000, bytes(range(256)) * 30, *[bytes(r.randrange(256) for _ in range(r.randrange(9000))) for _ in range(30)]]
    texts = [webp.padded(t) for t in texts]
    media = webp.Encoder.get().encode(texts)
    assert [webp.samples(p) for p in webp.decode(media)] == texts
    assert webp.Encoder.get().encode(texts[::-1]) == media[::-1]
    with pytest.raises(ValueError):
        webp.decode([media[3][: len(media[3]) // 2]])


def test_every_form_is_written_where_it_is_the_shortest():
    """What the decoder meets in stored texts: transforms by kind (0 predictor, 3 palette) and caches."""
    r = random.Random(4)
    row = bytes(r.randrange(256) for _ in range(192))
    slope = bytes(b for i in range(1024) for b in (i // 4 % 256, i // 2 % 256, i // 8 % 256))
    words = [bytes(r.choice(b"etaoinshrdlu") for _ in range(3)) for _ in range(60)]
    texts = [row * 16, slope, b"ab " * 1000, b"".join(r.choice([b"foo", b"bar", b"baz"]) for _ in range(1024)), b"".join(r.choice(words) for _ in range(1024)), b"The quick brown fox, which was by no means lazy, jumped. "]
    texts = [webp.padded(t) for t in texts]
    media = webp.Encoder.get().encode(texts)
    assert [webp.samples(p) for p in webp.decode(media)] == texts
    heads = [[webp.Header(p) for p in webp.payloads(m)][0] for m in media]
    assert [[k for k, *_ in h.transforms] for h in heads] == [[0], [0], [3] if heads[2].transforms else [], [3], [], []]
    assert heads[4].picture.cache and not heads[5].picture.cache
    assert all(len(m) < len(t) for m, t in list(zip(media, texts, strict=True))[:5])


def test_a_picture_of_another_encoder():
    """The one-pixel file by which browsers are asked whether they read lossless WebP."""
    (picture,), = webp.decode([base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")])
    assert picture.shape == (1, 1, 4) and picture[0, 0, 3] == 0


def test_stored_texts_are_described_as_the_contract_says(spark):
    import zlib

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    alone = webp.Encoder.get()
    for r in QUERIES["op8_lossless_webp"](spark, "/root/testdata/sf0.001").collect():
        t = texts[r.doc_id]
        full = t + b" " * (-len(t) % 192 if t else 192)
        media = alone.encode([full])[0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        a = np.frombuffer(full, np.uint8)
        shares = [int(((a >= 32 * k) & (a < 32 * k + 32)).sum()) * 255 // len(a) for k in range(8)]
        step = int(np.abs(np.diff(a.astype(int))).mean())
        assert r.feature == "".join(f"{x:02x}" for x in (*shares, min(255, step)))


class Writer(webp.BitWriter):
    """A plain writer of pictures that uses every feature of the format."""

    def picture(self, px, width, main, cache=0, groups=None):
        self.put(int(cache > 0), 1)
        if cache:
            self.put(cache, 4)
        bits = 2
        if main:
            self.put(int(groups is not None), 1)
            if groups is not None:
                self.put(bits - 2, 3)
                self.picture([g << 8 for g in groups], -(-width // 4), False)
        items, table, i = [], {}, 0
        while i < len(px):
            run = 0
            for d in (1, width, 2, 300):
                n = 0
                while d <= i and i + n < len(px) and n < 4000 and px[i + n] == px[i + n - d]:
                    n += 1
                if n > run:
                    run, far = n, d
            g = 0 if groups is None else groups[(i // width >> 2) * -(-width // 4) + (i % width >> 2)]
            slot = px[i] * 0x1E35A7BD % (1 << 32) >> (32 - cache) if cache else None
            if run >= 3:
                items.append((g, "ref", run, far))
            elif cache and table.get(slot) == px[i]:
                run = 1
                items.append((g, "hit", slot, 0))
            else:
                run = 1
                items.append((g, "lit", px[i], 0))
            for p in px[i : i + run]:
                if cache:
                    table[p * 0x1E35A7BD % (1 << 32) >> (32 - cache)] = p
            i += run

        def prefixed(v):
            v -= 1
            if v < 4:
                return v, 0, 0
            top = v.bit_length() - 1
            return 2 * top + (v >> (top - 1) & 1), v & ((1 << (top - 1)) - 1), top - 1

        n = (max(groups) + 1) if groups is not None else 1
        sizes = (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)
        use = [[Counter() for _ in sizes] for _ in range(n)]
        for g, kind, v, far in items:
            if kind == "lit":
                for c, s in zip(use[g], (v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24), strict=False):
                    c[s] += 1
            elif kind == "hit":
                use[g][0][280 + v] += 1
            else:
                use[g][0][256 + prefixed(v)[0]] += 1
                use[g][4][prefixed(self.code(far, width))[0]] += 1
        codes = []
        for group in use:
            row = []
            for c, size in zip(group, sizes, strict=True):
                if len(c) == 1 and max(c) < 256:
                    webp.put_single(self, max(c))
                    lengths = np.zeros(size, np.uint8)
                    row.append((lengths, lengths))
                    continue
                w = np.zeros(size)
                for s, k in c.items():
                    w[s] = k
                while (w > 0).sum() < 2:
                    w[np.flatnonzero(w == 0)[0]] = 0.1
                lengths = webp.huffman(w, 15)
                webp.put_lengths(self, lengths)
                row.append((webp.canonical(lengths), lengths))
            codes.append(row)

        def sym(g, k, s):
            self.put(int(codes[g][k][0][s]), int(codes[g][k][1][s]))

        for g, kind, v, far in items:
            if kind == "lit":
                for k, s in enumerate((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24)):
                    sym(g, k, s)
            elif kind == "hit":
                sym(g, 0, 280 + v)
            else:
                s, extra, bits_n = prefixed(v)
                sym(g, 0, 256 + s)
                self.put(extra, bits_n)
                s, extra, bits_n = prefixed(self.code(far, width))
                sym(g, 4, s)
                self.put(extra, bits_n)

    @staticmethod
    def code(far, width):
        for i, (x, y) in enumerate(webp.NEAR):
            if max(1, x + y * width) == far:
                return i + 1
        return far + 120

    def file(self):
        m = -(-self.n // 8)
        data = self.value.to_bytes(m, "little") + bytes(m & 1)
        return b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + m.to_bytes(4, "little") + data


def pack(px):
    return [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b, a in px]


def start(width, height):
    w = Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    return w


def random_picture(r, width, height, colours):
    table = r.integers(0, 256, (colours, 4))
    px = table[r.integers(0, colours, width * height)]
    px[20:50] = px[20]
    px[60:70] = px[60 - 2 : 70 - 2]
    return px


@pytest.mark.parametrize(("cache", "meta"), [(0, False), (5, False), (0, True), (4, True)])
def test_codes_references_cache_and_groups(cache, meta):
    r = np.random.default_rng(cache + meta)
    files, want = [], []
    for width, height in ((17, 9), (33, 20), (11, 8)):
        px = random_picture(r, width, height, 20 if cache else 300)
        groups = r.integers(0, 3, -(-width // 4) * -(-height // 4)).tolist() if meta else None
        w = start(width, height)
        w.put(0, 1)
        w.picture(pack(px), width, True, cache, groups)
        files.append(w.file())
        want.append(px.reshape(height, width, 4))
    for got, exp in zip(webp.decode(files), want, strict=True):
        assert (got[0] == exp).all()


def test_transforms_are_inverted():
    r = np.random.default_rng(7)
    width, height = 13, 11
    px = random_picture(r, width, height, 200).reshape(height, width, 4).astype(int)
    # Predictor: every mode of the format in one picture.
    per = -(-width // 4)
    modes = r.integers(0, 14, per * -(-height // 4)).tolist()
    modes[:14] = range(12)[: len(modes)] if len(modes) < 14 else range(14)
    bgra = px[:, :, [2, 1, 0, 3]].reshape(-1, 4).tolist()
    left = []
    for i in range(width * height):
        y, x = divmod(i, width)
        if y == 0:
            g = bgra[i - 1] if x else [0, 0, 0, 255]
        elif x == 0:
            g = bgra[i - width]
        else:
            g = webp.predict(modes[(y >> 2) * per + (x >> 2)], bgra[i - 1], bgra[i - width], bgra[i - width + 1], bgra[i - width - 1])
        b, gr, rd, a = ((p - q) & 255 for p, q in zip(bgra[i], g, strict=True))
        left.append(a << 24 | rd << 16 | gr << 8 | b)
    w = start(width, height)
    w.put(1, 1), w.put(0, 2), w.put(0, 3)
    w.picture([m << 8 for m in modes], per, False)
    w.put(0, 1)
    w.picture(left, width, True)
    assert (webp.decode([w.file()])[0][0] == px).all()
    # Cross-colour, then subtract-green.
    s8 = lambda v: (v & 255) - ((v & 128) << 1)
    f = [tuple(int(v) for v in r.integers(0, 256, 3)) for _ in range(per * -(-height // 4))]
    out = []
    for i, (rd, gr, b, a) in enumerate(px.reshape(-1, 4).tolist()):
        y, x = divmod(i, width)
        to_red, to_blue, red_blue = f[(y >> 2) * per + (x >> 2)]
        nr = (rd - (s8(to_red) * s8(gr) >> 5)) & 255
        nb = (b - (s8(to_blue) * s8(gr) >> 5) - (s8(red_blue) * s8(rd) >> 5)) & 255
        out.append(a << 24 | ((nr - gr) & 255) << 16 | gr << 8 | ((nb - gr) & 255))
    w = start(width, height)
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    w.picture([255 << 24 | z << 16 | y << 8 | x for x, y, z in f], per, False)
    w.put(1, 1), w.put(2, 2)
    w.put(0, 1)
    w.picture(out, width, True)
    assert (webp.decode([w.file()])[0][0] == px).all()


@pytest.mark.parametrize("colours", [2, 4, 11, 100])
def test_palettes(colours):
    r = np.random.default_rng(colours)
    width, height = 19, 7
    table = r.integers(0, 256, (colours, 4))
    index = r.integers(0, colours, (height, width))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    packed = []
    for row in index.tolist():
        for x in range(0, width, 1 << bits):
            packed.append(255 << 24 | sum(v << (k * (8 >> bits)) for k, v in enumerate(row[x : x + (1 << bits)])) << 8)
    deltas = (np.diff(table, axis=0, prepend=0) & 255).tolist()
    w = start(width, height)
    w.put(1, 1), w.put(3, 2), w.put(colours - 1, 8)
    w.picture(pack(deltas), colours, False)
    w.put(0, 1)
    w.picture(packed, -(-width // (1 << bits)), True)
    assert (webp.decode([w.file()])[0][0] == table[index]).all()
