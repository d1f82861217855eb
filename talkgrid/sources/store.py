"""Writing to a note store: atomic documents, appended segments, versions behind a checked pointer, rebuilds, re-transcription.

Paths go through Hadoop's file systems, so a store may lie wherever Spark reads. A document is replaced by one rename.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Files:
    """Small files of a store: read, written at once, listed, removed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _store(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._store(path).exists(self._path(path))

    def read(self, path: str) -> str | None:
        """The text of a file; None where there is none."""
        if not self.exists(path):
            return None
        stream = self._store(path).open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace(self, source: str, target: str) -> None:
        """One rename that takes the target's place; a reader finds the old file or the new one."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(target).getFileSystem(self.conf).getUri(), self.conf)
        kinds = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.java.lang.Enum.valueOf(kinds, "OVERWRITE")
        context.rename(self._path(source), self._path(target), options)

    def write(self, path: str, text: str) -> None:
        """Writes a file beside its place and renames it into it."""
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        out = self._store(tmp).create(self._path(tmp), True)
        try:
            out.write(text.encode())
        finally:
            out.close()
        try:
            self.replace(tmp, path)
        except Exception:
            self._store(tmp).delete(self._path(tmp), False)
            raise

    def write_json(self, path: str, value) -> None:
        self.write(path, json.dumps(value, ensure_ascii=False, indent=1))

    def read_json(self, path: str, default=None):
        """The value of a JSON file; the default where there is none or it can't be read."""
        try:
            text = self.read(path)
            return default if text is None else json.loads(text)
        except ValueError:
            return default

    def rewrite_lines(self, path: str, edit: Callable[[dict], dict | None]) -> int:
        """Rewrites JSON lines at once: a line whose value ``edit`` leaves as it is keeps its raw text, one that it drops
        (None) goes, one that can't be read stays. The number of lines changed."""
        out, changed = [], 0
        for raw in (self.read(path) or "").splitlines():
            try:
                value = json.loads(raw)
                new = edit(json.loads(raw)) if isinstance(value, dict) else value
            except ValueError:
                out.append(raw)
                continue
            if new == value:
                out.append(raw)
            else:
                changed += 1
                if new is not None:
                    out.append(json.dumps(new, ensure_ascii=False))
        self.write(path, "".join(f"{x}\n" for x in out))
        return changed

    def names(self, path: str) -> list[tuple[str, int, int]]:
        """(name, length, time) of what is in a folder, by name."""
        if not self.exists(path):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self._store(path).listStatus(self._path(path)))

    def remove(self, path: str) -> None:
        self._store(path).delete(self._path(path), True)


class SegmentAppender:
    """Appends a note's final segments. Lines that can't be written wait in memory, in order, and go out before the next."""

    def __init__(self, write: Callable[[list[str]], None], first_seq: int = 0, most: int | None = None):
        self.write, self.seq, self.waiting, self.most = write, first_seq, deque(), most

    def append(self, source: str, text: str, start_ms: int, end_ms: int, speaker: str | None = None, rms: float | None = None) -> int:
        """The segment's number; it may still be waiting."""
        row = {"seq": self.seq, "source": source, "text": text, "start_ms": start_ms, "end_ms": end_ms, "speaker": speaker, "rms": rms}
        if self.most is not None and len(self.waiting) >= self.most:
            raise OSError(f"{len(self.waiting)} segments wait to be written")
        self.waiting.append(json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False))
        self.seq += 1
        self.drain()
        return row["seq"]

    def drain(self) -> int:
        """Writes what waits, oldest first, up to the first line that fails; how many still wait."""
        while self.waiting:
            try:
                self.write([self.waiting[0]])
            except OSError:
                break
            self.waiting.popleft()
        return len(self.waiting)


def set_waveform(files: Files, note: str, source: str, waveform: list[int]) -> None:
    """Puts a track's waveform into a note's metadata; the rest stays."""
    meta = files.read_json(f"{note}/meta.json", {}) or {}
    meta.setdefault("audio", {}).setdefault("tracks", {}).setdefault(source, {})["waveform"] = waveform
    files.write_json(f"{note}/meta.json", meta)


# -- versions ---------------------------------------------------------------------------------------------------------


def _manifest(files: Files, path: str) -> str:
    """A checksum over the names and lengths of a version's files."""
    return hashlib.sha256(json.dumps([(n, size) for n, size, _ in files.names(path) if not n.startswith((".", "_"))]).encode()).hexdigest()


def publish(df: DataFrame, root: str, build_id: str, keep: int = 2, **facts) -> dict:
    """Writes an immutable version, and then a pointer with its checksum in one rename; of older versions the newest ``keep``
    stay. The pointer."""
    files = Files(df.sparkSession)
    path = f"{root}/v={build_id}"
    df.write.mode("errorifexists").parquet(path)
    before = (pointer(df.sparkSession, root) or {}).get("versions", [])
    new = {"build_id": build_id, "path": path, "checksum": _manifest(files, path), "versions": [build_id, *[v for v in before if v != build_id]][: keep + 1], **facts}
    files.write_json(f"{root}/pointer.json", new)
    for name, _, _ in files.names(root):
        if name.startswith("v=") and name[2:] not in new["versions"]:
            files.remove(f"{root}/{name}")
    return new


def pointer(spark: SparkSession, root: str) -> dict | None:
    return Files(spark).read_json(f"{root}/pointer.json")


def published(spark: SparkSession, root: str) -> DataFrame:
    """The version that the pointer names; an error if its files are not those that were published."""
    now = pointer(spark, root)
    if now is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    if _manifest(Files(spark), now["path"]) != now["checksum"]:
        raise ValueError(f"version {now['build_id']} is damaged")
    return spark.read.parquet(now["path"])


def rebuild(spark: SparkSession, root: str, snapshot: Callable[[], tuple[str, DataFrame]], digest: Callable[[], str], rounds: int = 32, **facts) -> dict:
    """Builds from a snapshot (its digest and the table) and publishes it if the source still has that digest, else takes a
    new snapshot; an error after ``rounds`` changes."""
    for _ in range(rounds):
        seen, table = snapshot()
        ready = table.persist()
        try:
            ready.count()
            if digest() == seen:
                return publish(ready, root, f"{time.time_ns()}-{seen[:12]}", source=seen, **facts)
        finally:
            ready.unpersist()
    raise RuntimeError(f"the source changed in each of {rounds} builds")


class Rebuilds:
    """Requests for a rebuild as marker files: any number of them before a build are met by that one build, and
    generations only rise."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root, Files(spark)

    def _asked(self) -> list[int]:
        return [int(n.split("-")[0]) for n, _, _ in self.files.names(f"{self.root}/requests")]

    def done(self) -> int:
        return (pointer(self.spark, self.root) or {}).get("generation", 0)

    def request(self) -> int:
        """A new generation, which is dirty until a build has met it."""
        generation = max([self.done(), *self._asked()]) + 1
        self.files.write(f"{self.root}/requests/{generation:012d}-{uuid.uuid4().hex}", "")
        return generation

    def dirty(self) -> bool:
        return any(g > self.done() for g in self._asked())

    def run(self, snapshot: Callable[[], tuple[str, DataFrame]], digest: Callable[[], str]) -> int:
        """Builds once for all requests there are, and again only for those that came meanwhile. The number of builds."""
        builds = 0
        while self.dirty():
            upto = max(self._asked())
            rebuild(self.spark, self.root, snapshot, digest, generation=upto)
            builds += 1
            for name, _, _ in self.files.names(f"{self.root}/requests"):
                if int(name.split("-")[0]) <= upto:
                    self.files.remove(f"{self.root}/requests/{name}")
        return builds


# -- re-transcription -------------------------------------------------------------------------------------------------


def commit_transcript(files: Files, note: str, segments: list[dict], speakers: dict[str, dict]) -> None:
    """Puts a new transcript in the place of a note's old one. What was there is backed up once and never again; the document
    becomes stale and its revision rises; the speaker table is the union of old and new before segments change and only the
    new ones after, so that no segment is ever without its speaker; suppressions and the time map, which belong to the
    old segments, go. Every step may be taken again after a crash."""
    old = files.read(f"{note}/segments.jsonl") or ""
    if not files.exists(f"{note}/segments.orig.jsonl"):
        files.write(f"{note}/segments.orig.jsonl", old)
    doc = files.read_json(f"{note}/aing.json")
    if isinstance(doc, dict):
        files.write_json(f"{note}/aing.json", doc | {"stale": True, "revision": int(doc.get("revision", 0)) + 1})
    table = files.read_json(f"{note}/speakers.json", {}) or {}
    files.write_json(f"{note}/speakers.json", table | {k: table.get(k, {}) | v for k, v in speakers.items()})
    files.write(f"{note}/segments.jsonl", "".join(json.dumps(s, ensure_ascii=False) + "\n" for s in segments))
    for name in ("segment-suppressions.jsonl", "time_map.json"):
        files.remove(f"{note}/{name}")
    used = {s.get("speaker") for s in segments}
    files.write_json(f"{note}/speakers.json", {k: table.get(k, {}) | speakers.get(k, {}) for k in sorted({*speakers, *table}) if k in used or k in speakers})
