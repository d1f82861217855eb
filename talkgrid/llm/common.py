"""Helpers shared by the operators: checkpoints, shared files, word hashes and bounded batches."""

from __future__ import annotations

import atexit
import contextlib
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one in-memory step of a worker takes on at once.
STEP_BYTES = 3 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, whose executor is the driver,
    may do without the setting and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='talkgrid-shared-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_shared_folder(spark: SparkSession, kind: str, keep: bool = False) -> str:
    """A fresh folder below the shared root; created on first write and, unless ``keep``, removed when the driver's Python
    ends (results are lazy, so they may need it until then)."""
    folder = f"{shared_root(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if not keep:
        atexit.register(_remove, folder)
    return folder


def _remove(uri: str) -> None:
    from pyarrow import fs

    with contextlib.suppress(Exception):  # at the very end, and the folder may never have been written
        store, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        store.delete_dir(path)


#: Tasks that a dealt stage has at most; a task then takes several groups, one after another.
MAX_TASKS = 20_000


def dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """``df`` in one partition for each group (key: from 0 to ``groups`` - 1), so tasks grow in number, not in size."""
    return df.repartitionById(groups, F.col(key)) if groups <= MAX_TASKS else df.repartition(MAX_TASKS, key)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_bytes(uri: str, *parts: bytes) -> None:
    """Write one shared file. The rename makes a repeated or speculative attempt harmless."""
    p = urlparse(uri)
    if p.scheme in ("", "file"):
        os.makedirs(os.path.dirname(p.path), exist_ok=True)
        tmp = f"{p.path}.{uuid.uuid4().hex}.tmp"
        with open(tmp, "wb") as f:
            for x in parts:
                f.write(x)
        os.replace(tmp, p.path)
        return
    store, path = _remote(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(f"{path}.tmp") as f:
        for x in parts:
            f.write(x)
    store.move(f"{path}.tmp", path)


def map_array(uri: str, dtype) -> np.ndarray:
    """Memory-map a shared file of plain values. A file of a remote store is first copied to an unlinked local file."""
    p = urlparse(uri)
    if p.scheme in ("", "file"):
        f = open(p.path, "rb")  # noqa: SIM115
    else:
        store, path = _remote(uri)
        f = tempfile.TemporaryFile()  # noqa: SIM115
        with store.open_input_stream(path) as src:
            while block := src.read(1 << 20):
                f.write(block)
        f.flush()
    with f:
        if not os.fstat(f.fileno()).st_size:
            return np.zeros(0, dtype)
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype)


@contextlib.contextmanager
def open_input(uri: str) -> Iterator:
    """A shared file as a readable stream."""
    p = urlparse(uri)
    if p.scheme in ("", "file"):
        with open(p.path, "rb") as f:
            yield f
    else:
        store, path = _remote(uri)
        with store.open_input_stream(path) as f:
            yield f


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; forgets everything once it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def give_back() -> None:
    """Returns a worker's freed memory to the system, where the C library can; workers are used again and would keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result (fixed odd constants of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of 64-bit hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019) + mix(b))


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text at most, but one row at least; never over 65,536 rows."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            to = min(at + (1 << 16), max(at + 1, int(np.searchsorted(size, base + limit, "right"))))
            yield b.slice(at, to - at)
            at = to


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary())
    return [x or b"" for x in col.to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
