"""The agent tool surface and the command line: plain functions over a note store's folder, returning rows as dictionaries."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.functions import text as T
from talkgrid.operators import notes as N
from talkgrid.operators import pipelines as P
from talkgrid.operators import windows as W
from talkgrid.operators.graph import CORE_PREDICATES
from talkgrid.sources import files as S
from talkgrid.sources import store as ST

#: Fixed value: the version of the contract by which agents hand in graphs.
CONTRACT = 2


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Store:
    """Tools over a note store; results are pages or one note's rows, so what comes to the caller is bounded. ``bridge`` (a
    function of an operation's name and its arguments) is the running recorder, which the tools on recording ask; without one
    they say that it isn't running."""

    def __init__(self, spark: SparkSession, root: str, bridge=None):
        self.spark, self.root, self.bridge, self.files = spark, root, bridge, ST.Files(spark)

    def _note(self, note_id: str) -> str:
        """A note's folder; an error for an id that leads elsewhere or that there is none of."""
        if not note_id or any(x in note_id for x in ("/", "\\", "..")):
            raise ValueError(f"not a note id: {note_id!r}")
        path = f"{self.root}/{note_id}"
        if not self.files.exists(path):
            raise FileNotFoundError(f"no note {note_id}")
        return path

    def _segments(self) -> DataFrame:
        return N.visible(S.scan_segments(self.spark, self.root), S.scan_suppressions(self.spark, self.root))

    def list_notes(self, from_: str | None = None, to: str | None = None, offset: int = 0, limit: int = 20) -> list[dict]:
        return _rows(N.page(N.time_range(S.scan_meta(self.spark, self.root), from_, to), [F.desc("started_at"), F.desc("id")], offset, limit))

    def get_note(self, note_id: str) -> dict:
        meta = _rows(S.scan_meta(self.spark, self.root).where(F.col("id") == note_id))
        return (meta[0] if meta else {}) | {"segments": _rows(self._segments().where(F.col("note_id") == note_id).orderBy("start_ms", "seq"))}

    def search_notes(self, query: str, limit: int = 20) -> list[dict]:
        hits = N.search(self._segments(), query).orderBy("note_id", "start_ms", "seq")
        return _rows(hits.limit(min(100, max(1, limit))))

    def list_speakers(self) -> list[dict]:
        return _rows(S.scan_speakers(self.spark, self.root).orderBy("note_id", "speaker_id").limit(1000))

    def get_paragraphs(self, note_id: str) -> list[dict]:
        return _rows(W.paragraphs(self._segments().where(F.col("note_id") == note_id)).orderBy("paragraph"))

    def export_note(self, note_id: str) -> str:
        got = N.export(self._segments().where(F.col("note_id") == note_id)).first()
        return got["content"] if got else ""

    def list_log(self, limit: int = 50) -> list[dict]:
        return _rows(S.scan_log(self.spark, f"{self.root}/ailog").limit(min(500, max(1, limit))))


    # -- writing back

    def _document(self, note_id: str) -> tuple[str, dict]:
        path = f"{self._note(note_id)}/aing.json"
        doc = self.files.read_json(path)
        if not isinstance(doc, dict) or not isinstance(doc.get("paragraphs"), list):
            raise ValueError(f"note {note_id} has no refined document")
        return path, doc

    def apply_refined_texts(self, note_id: str, updates: list[dict], model: str | None = None) -> dict:
        """Puts texts (index, text) into the paragraphs of a note's refined document, all or none; speakers, times and the
        number of paragraphs stay. What was made from the old texts becomes stale."""
        path, doc = self._document(note_id)
        paragraphs, seen = doc["paragraphs"], set()
        for u in updates:
            i, text = u.get("index"), u.get("text")
            if not isinstance(i, int) or not 0 <= i < len(paragraphs) or i in seen or not isinstance(text, str) or not text.strip():
                raise ValueError(f"update of paragraph {i!r} is not valid")
            seen.add(i)
        changed = [u for u in updates if paragraphs[u["index"]].get("text") != u["text"]]
        for u in changed:
            paragraphs[u["index"]] |= {"text": u["text"], "mentions": []}
        if changed:
            doc["stages"] = doc.get("stages", {}) | {"text": "done", "entities": "stale", "relations": "stale"}
            doc["revision"] = int(doc.get("revision", 0)) + 1
            doc["model"] = model or doc.get("model")
            self.files.write_json(path, doc)
        return {"note_id": note_id, "updated": len(changed), "revision": doc.get("revision", 0), "source_hash": self._hash(doc)}

    def _hash(self, doc: dict) -> str:
        rows = [(i, ",".join(map(str, p.get("source_seqs") or [])), p.get("text") or "") for i, p in enumerate(doc["paragraphs"])]
        df = self.spark.createDataFrame(rows, "index int, seqs string, text string")
        return df.select(T.source_hash_lines("index", "seqs", "text")).first()[0] if rows else ""

    def get_aing_context(self, note_id: str) -> dict:
        """What an agent needs to hand in a graph: paragraphs, local entities, mentions that are more than support, predicates,
        the contract's version and the hash of the source."""
        _, doc = self._document(note_id)
        support = set(doc.get("graph_support_mentions") or [])
        paragraphs = [{"index": i, "text": p.get("text") or "", "source_seqs": p.get("source_seqs") or [], "speaker": p.get("speaker"), "mentions": [m for m in p.get("mentions") or [] if m.get("id") not in support]} for i, p in enumerate(doc["paragraphs"])]
        return {"note_id": note_id, "paragraphs": paragraphs, "entities": doc.get("entities") or [], "predicates": [*CORE_PREDICATES, "custom"], "contract_version": CONTRACT, "source_hash": self._hash(doc)}

    def apply_aing_graph(self, note_id: str, entities: list[dict], relations: list[dict], contract_version: int, model: str) -> dict:
        """Checks an agent's graph, makes its ids, mentions and evidence anew, and writes it into the note's document."""
        path, doc = self._document(note_id)
        graph = P.agent_graph([{"index": i, "text": p.get("text") or ""} for i, p in enumerate(doc["paragraphs"])], entities, relations, contract_version, CONTRACT, self.spark)
        for i, p in enumerate(doc["paragraphs"]):
            p["mentions"] = [m for m in graph["mentions"] if m["paragraph"] == i]
        doc |= {"entities": graph["entities"], "relations": graph["relations"], "evidence": graph["evidence"], "graph_extraction": {"contract_version": CONTRACT, "source_hash": self._hash(doc), "model": model}}
        doc["stages"] = doc.get("stages", {}) | {"entities": "done", "relations": "done"}
        doc["revision"] = int(doc.get("revision", 0)) + 1
        self.files.write_json(path, doc)
        return {"note_id": note_id, "entities": len(graph["entities"]), "relations": len(graph["relations"]), "mentions": len(graph["mentions"]), "revision": doc["revision"]}

    def identify_speakers(self, note_id: str) -> dict:
        """The note's last identification of speakers; ``stale`` if the document has changed since."""
        got = self.files.read_json(f"{self._note(note_id)}/identify.json", {}) or {}
        doc = self.files.read_json(f"{self._note(note_id)}/aing.json", {}) or {}
        return got | {"note_id": note_id, "stale": bool(got) and got.get("revision") != doc.get("revision")}

    def graph(self, table: str, limit: int = 100) -> list[dict]:
        """Rows of a published table of the graph."""
        return _rows(ST.published(self.spark, f"{self.root}/graph/{table}").limit(min(1000, max(1, limit))))

    # -- recording, which the running recorder does

    def _ask(self, operation: str, **arguments) -> dict:
        return self.bridge(operation, arguments) if self.bridge else {"state": "not_running"}

    def recording_status(self) -> dict:
        return self._ask("status")

    def get_live_transcript(self, tail: int = 50) -> dict:
        return self._ask("live", tail=min(500, max(1, tail)))

    def start_recording(self, title: str | None = None) -> dict:
        return self._ask("start", title=title)

    def stop_recording(self) -> dict:
        return self._ask("stop")

    def pause_recording(self) -> dict:
        return self._ask("pause")

    def resume_recording(self) -> dict:
        return self._ask("resume")

    def retranscribe_note(self, note_id: str, input: str | None = None, engine: str | None = None) -> dict:
        self._note(note_id)
        return self._ask("retranscribe", note_id=note_id, input=input, engine=engine)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="talkgrid", description="Query a note store.")
    p.add_argument("--root", required=True)
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="tool", required=True)
    a = sub.add_parser("list")
    a.add_argument("--from", dest="from_")
    a.add_argument("--to")
    a.add_argument("--offset", type=int, default=0)
    a.add_argument("--limit", type=int, default=20)
    for name, arg in (("get", "note_id"), ("export", "note_id"), ("paragraphs", "note_id"), ("search", "query")):
        sub.add_parser(name).add_argument(arg)
    sub.add_parser("speakers")
    sub.add_parser("ailog")
    for name in ("context", "identify"):
        sub.add_parser(name).add_argument("note_id")
    sub.add_parser("status")
    w = sub.add_parser("write-texts")
    w.add_argument("note_id")
    w.add_argument("updates", help="JSON list of index and text")
    o = p.parse_args(argv)
    store = Store(SparkSession.builder.getOrCreate(), o.root)
    got = {
        "list": lambda: store.list_notes(o.from_, o.to, o.offset, o.limit), "get": lambda: store.get_note(o.note_id), "export": lambda: store.export_note(o.note_id),
        "paragraphs": lambda: store.get_paragraphs(o.note_id), "search": lambda: store.search_notes(o.query), "speakers": store.list_speakers, "ailog": store.list_log, "context": lambda: store.get_aing_context(o.note_id),
        "identify": lambda: store.identify_speakers(o.note_id), "status": store.recording_status, "write-texts": lambda: store.apply_refined_texts(o.note_id, json.loads(o.updates)),
    }[o.tool]()
    if o.json or not isinstance(got, (list, str)):
        print(json.dumps(got, ensure_ascii=False, default=str))
    elif isinstance(got, str):
        print(got, end="")
    else:
        for r in got:
            print("\t".join(str(v) for v in r.values()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
