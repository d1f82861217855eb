"""WARC archives as a chunked record table.

Payloads travel as (record id, chunk number, bytes) rows, each with the running SHA-1 of the record up to that chunk,
so that no step after the source's own row holds a whole record: the JVM splits payloads before anything is shuffled,
writers append chunk after chunk to an archive, readers stream through an archive with a fixed buffer and give chunk rows
back.

Archives are standard ones (one gzip member a record; responses hold an HTTP message and name their URI), and the reader
takes others as well: any WARC version, any record id and type, plain files, HTTP messages whose body is the payload,
records without digest. A revisit carries no payload; its length comes from the response that it refers to.

Null payloads count as empty, null ids are written as an empty record id and read back as null. Rows that repeat an
id and payload each become a record. Null URIs are left out. Empty tables give no archive and no rows. Other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, new_shared_folder, open_input

#: Bytes of one chunk, and of an HTTP head at most.
CHUNK, HTTP_HEAD = 256 << 10, 1 << 20
_HEAD = "WARC/1.1\r\n"
_URN = "<urn:talkgrid:{}>"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: What reading gives: ``record_id`` and ``refers_to`` are null for ids that are no numbers of this writer's; payload_bytes is
#: null for revisits, payload_digest what the header says (null if nothing), running_sha1 that of the bytes read so far.
CHUNKS = "record_uri string, record_id long, seq long, record_type string, target_uri string, refers_to_uri string, refers_to long, chunk_no int, n_chunks int, data binary, running_sha1 string, payload_digest string, payload_bytes long"
_SPEC = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in CHUNKS.split(", ")])


def b32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def plan_chunks(pages: DataFrame, id_col: str = "page_id", payload: str = "html", url: str | None = None, min_bytes: int = 0, size: int = CHUNK) -> DataFrame:
    """Chunk rows of the records to write: a row's chunks together and in order, each with the record's type and refers_to.

    Of the records with equal payloads of at least ``min_bytes`` bytes, those with the smallest id (nulls last) are
    responses, the others revisits; revisits carry no payload. The partial aggregation leaves one row for each digest
    and task, so a payload that a third of the rows share makes no hot task. Chunks, not payloads, meet the table of repeated
    digests; Spark may split that join's hot partition by the tasks that wrote it, which leaves a row's chunks together.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    uri = F.col(url) if url else F.lit(None).cast("string")
    n = F.octet_length("body").cast("long")
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), uri.alias("target_uri"), body.alias("body"), F.monotonically_increasing_id().alias("row"))
    count = F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(F.col("body"), k * size + 1, F.lit(size)))
    rows = rows.select("record_id", "target_uri", "row", F.sha1("body").alias("sha1"), n.alias("payload_bytes"), count.alias("n_chunks"), parts.alias("parts"))
    # No array is empty; "outer" keeps the optimizer from making each array twice to see that. The array itself goes no further.
    chunks = rows.select("record_id", "target_uri", "row", "sha1", "payload_bytes", "n_chunks", F.posexplode_outer("parts").alias("chunk_no", "data"))
    first = pages.select(F.col(id_col).cast("long").alias("record_id"), F.sha1(body).alias("sha1"), F.octet_length(body).alias("n")).where(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha1", "first_id")
    again = F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    # A hash table of repeated digests leaves one sort to a task: that which puts a row's chunks in order.
    joined = chunks.join(first.hint("shuffle_hash"), "sha1", "left").withColumn("again", again).where("not again or chunk_no = 0")
    kind, none = F.when(F.col("again"), "revisit").otherwise("response"), F.lit("").cast("binary")
    return joined.select("record_id", "target_uri", "sha1", "payload_bytes", "row", kind.alias("record_type"), F.when(F.col("again"), F.col("first_id")).alias("refers_to"), "chunk_no", F.when(F.col("again"), 1).otherwise(F.col("n_chunks")).alias("n_chunks"), F.when(F.col("again"), none).otherwise(F.col("data")).alias("data")).sortWithinPartitions("sha1", "row", "chunk_no")


def _header(r: dict) -> bytes:
    """A record's head, with the head of the HTTP message that holds a response's payload."""
    http, uri = "", r.get("target_uri")
    lines = [_HEAD + f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {_URN.format('' if r['record_id'] is None else r['record_id'])}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", uri))
    lines.append(f"WARC-Payload-Digest: sha1:{b32(bytes.fromhex(r['sha1']))}")
    if r["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_URN.format(r['refers_to'])}", "Content-Length: 0"]
    else:
        http = _HTTP.format(r["payload_bytes"])
        lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + r['payload_bytes']}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


class ArchiveWriter:
    """Appends records to a .warc.gz stream, one gzip member each, chunk by chunk."""

    def __init__(self, out, level: int = 1):
        self.out, self.level, self.member = out, level, None

    def add(self, row: dict) -> None:
        if row["chunk_no"] == 0:
            self.member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
            self.out.write(self.member.compress(_header(row)))
        self.out.write(self.member.compress(row["data"]))
        if row["chunk_no"] == row["n_chunks"] - 1:
            self.out.write(self.member.compress(b"\r\n\r\n") + self.member.flush())
            self.member = None


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes one archive a task below ``folder`` (shared by all executors); one row (archive, records, bytes) each.

    An attempt writes under its own name and renames at its end, so a task that runs twice leaves one archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, records, out, writer, tmp = f"{folder}/part-{part:06d}.warc.gz", 0, None, None, None
        for b in batches:
            for row in (r for k in range(0, b.num_rows, 64) for r in b.slice(k, 64).to_pylist()):
                if out is None:
                    out, tmp, close = _sink(name)
                    writer = ArchiveWriter(out)
                writer.add(row)
                records += row["chunk_no"] == 0
            del b
        give_back()
        if out is not None:
            size = out.tell()
            out.close()
            close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [records], "bytes": [size]}, pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return chunks.mapInArrow(write, "archive string, records long, bytes long")


def _sink(uri: str):
    from urllib.parse import urlparse

    p = urlparse(uri)
    if p.scheme in ("", "file"):
        os.makedirs(os.path.dirname(p.path), exist_ok=True)
        fd, tmp = tempfile.mkstemp(dir=os.path.dirname(p.path), suffix=".tmp")
        return os.fdopen(fd, "wb"), tmp, lambda: os.replace(tmp, p.path)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{os.getpid()}.tmp"
    return store.open_output_stream(tmp), tmp, lambda: store.move(tmp, path)


class _Members:
    """A buffered reader over a stream, of concatenated gzip members or plain; never holds more than a block or two."""

    def __init__(self, raw, block: int = 128 << 10):
        self.raw, self.block, self.buf, self.left, self.z, self.plain = raw, block, bytearray(), b"", None, None

    def _more(self) -> bool:
        while True:
            data = self.left or self.raw.read(self.block)
            if self.plain is None:
                self.plain = data[:2] != b"\x1f\x8b"
            if not data:
                if self.z is not None:
                    raise ValueError("truncated archive")
                return False
            if self.plain:
                self.buf += data
                return True
            self.left = b""
            if self.z is None:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(data, 4 * self.block)
            self.left = self.z.unconsumed_tail
            if self.z.eof:
                self.left, self.z = self.z.unused_data, None
            if got:
                self.buf += got
                return True

    def at_end(self) -> bool:
        """Passes the line ends between records; whether nothing follows."""
        while True:
            del self.buf[: len(self.buf) - len(self.buf.lstrip(b"\r\n"))]
            if self.buf:
                return False
            if not self._more():
                return True

    def until(self, mark: bytes, most: int) -> bytes | None:
        """Bytes before the mark, which is consumed; None if it isn't within the next ``most`` bytes."""
        while (i := self.buf.find(mark, 0, most)) < 0:
            if len(self.buf) >= most or not self._more():
                return None
        got = bytes(self.buf[:i])
        del self.buf[: i + len(mark)]
        return got

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self._more():
                raise ValueError("truncated archive")
        got = bytes(self.buf[:n])
        del self.buf[:n]
        return got


def fields(head: bytes) -> dict[str, str]:
    """Header fields by name in small letters; a line that begins with a blank continues the one before."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _digest(value: str | None) -> str | None:
    """A digest field; SHA-1 in base32 without its name, however it is written."""
    if value is None or not value.lower().startswith("sha1:"):
        return value
    value = value[5:]
    return b32(bytes.fromhex(value)) if re.fullmatch(r"[0-9A-Fa-f]{40}", value) else value.upper()


def _own_id(uri: str | None) -> int | None:
    m = re.fullmatch(r"urn:talkgrid:(-?\d+)", uri or "")
    return int(m.group(1)) if m else None


def read_stream(raw, size: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive stream, with the running digest; a payload that doesn't match its SHA-1 is an error."""
    src, seq = _Members(raw), 0
    while not src.at_end():
        head = src.until(b"\r\n\r\n", HTTP_HEAD)
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError("truncated archive" if head is None else f"not a WARC record: {head[:40]!r}")
        h = fields(head)
        n, kind, sha, encoded = int(h["content-length"]), h.get("warc-type", ""), hashlib.sha1(), False
        if h.get("content-type", "").lower().startswith("application/http") and kind in ("response", "revisit"):
            http = src.until(b"\r\n\r\n", min(n, HTTP_HEAD))
            if http is not None:
                n -= len(http) + 4
                encoded = "transfer-encoding" in fields(http)
        count = max(1, -(-n // size))
        uri, refers = (h[c].strip("<>") if c in h else None for c in ("warc-record-id", "warc-refers-to"))
        digest = _digest(h.get("warc-payload-digest"))
        base = {"record_uri": uri, "record_id": _own_id(uri), "seq": seq, "record_type": kind, "target_uri": h.get("warc-target-uri", "").strip("<>") or None, "refers_to_uri": refers, "refers_to": _own_id(refers), "n_chunks": count, "payload_digest": digest, "payload_bytes": None if kind == "revisit" else n}
        for k in range(count):
            data = src.take(min(size, n - k * size))
            sha.update(data)
            yield base | {"chunk_no": k, "data": data, "running_sha1": b32(sha.copy().digest())}
        if kind in ("response", "resource") and digest and ":" not in digest and not encoded and b32(sha.digest()) != digest:
            raise ValueError(f"digest mismatch in record {uri}")
        seq += 1


def read_archives(archives: DataFrame, with_data: bool = True, size: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives named in column ``archive``. Rows leave in small batches, so memory stays bounded."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(b.schema.get_field_index("archive")).to_pylist():
                with open_input(name) as raw:
                    rows, held = [], 0
                    for r in read_stream(raw, size):
                        held += len(r["data"]) + 200
                        rows.append(r if with_data else r | {"data": None})
                        if held > 2 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _SPEC)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _SPEC)
                    del rows
        give_back()

    return archives.mapInArrow(read, CHUNKS)


def archive_pages(pages: DataFrame, id_col: str = "page_id", payload: str = "html", min_bytes: int = 0, folder: str | None = None, url: str | None = None) -> DataFrame:
    """Writes every row as a WARC record below ``folder`` and returns the table of archives. Without a folder they lie in the
    shared one, until the driver ends."""
    folder = folder or new_shared_folder(pages.sparkSession, "warc")
    # Archives exist once the table of them does.
    return cut(write_archives(plan_chunks(pages, id_col, payload, url, min_bytes), folder))


def records(chunks: DataFrame) -> DataFrame:
    """One row a record, from its last chunk row: digest of what was read back and length; null record ids stay."""
    return chunks.where("chunk_no = n_chunks - 1").drop("data", "chunk_no", "n_chunks")


def resolved(records_: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` of revisits filled in from a response of the same id and digest as they name, and
    ``digest``, that of the bytes read back, which for a revisit are the response's. Both are null where no response fits."""
    rows = records_.persist(StorageLevel.DISK_ONLY)  # archives are read once; what a lost executor held is read again
    known = rows.where("record_type <> 'revisit'").select(F.col("record_uri").alias("refers_to_uri"), F.col("running_sha1").alias("payload_digest"), F.col("payload_bytes").alias("known_bytes")).distinct()
    again = rows.where("record_type = 'revisit'").join(known, ["refers_to_uri", "payload_digest"], "left")
    again = again.withColumns({"payload_bytes": F.col("known_bytes"), "digest": F.when(F.col("known_bytes").isNotNull(), F.col("payload_digest"))}).drop("known_bytes")
    return rows.where("record_type <> 'revisit'").withColumn("digest", F.col("running_sha1")).unionByName(again)
