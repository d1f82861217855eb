"""Whole runs made of operators: refining a note, transcribing it again, an agent's graph, libraries for a new model; and the
parts that models take in them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions import spans as S
from talkgrid.functions import text as T
from talkgrid.operators import joins as J
from talkgrid.operators import ledger as L
from talkgrid.operators import windows as W


class Embedder(Protocol):
    """Samples to a vector; None where they are too short."""

    def __call__(self, samples: np.ndarray) -> np.ndarray | None: ...


class Recogniser(Protocol):
    """Samples to a text and a language."""

    def __call__(self, samples: np.ndarray) -> tuple[str, str | None]: ...


class Cutter(Protocol):
    """Takes samples and gives closed segments; see :class:`talkgrid.operators.audio.Segmenter`."""

    def accept(self, samples: np.ndarray) -> None: ...

    def flush(self) -> None: ...

    def take_finished(self) -> list[tuple[int, int]]: ...


def embedded(clips: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """clips (with samples) and their ``embedding``; the model is made once a worker's partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for g in batches:
            got = [model(np.asarray(x, float)) for x in g["samples"]]
            yield g.drop(columns="samples").assign(embedding=[None if v is None else np.asarray(v, float).tolist() for v in got])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in clips.schema if f.name != "samples"]
    return clips.mapInPandas(run, ", ".join([*fields, "embedding array<double>"]))


def recognised(clips: DataFrame, make: Callable[[], Recogniser]) -> DataFrame:
    """clips (with samples) and their ``text`` and ``lang``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for g in batches:
            got = [model(np.asarray(x, float)) for x in g["samples"]]
            yield g.drop(columns="samples").assign(text=[t for t, _ in got], lang=[lang for _, lang in got])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in clips.schema if f.name != "samples"]
    return clips.mapInPandas(run, ", ".join([*fields, "text string", "lang string"]))


def refine(segments: DataFrame, cap_ms: int = 60_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A note's local refinement: segments without noise and empty ones, (note_id, speaker, segments, ms) of its clusters,
    and its paragraphs. segments: note_id, seq, speaker, text, start_ms, end_ms, lang."""
    kept = segments.where(~T.is_noise(F.col("text"), F.col("end_ms") - F.col("start_ms"), F.col("lang")) & ~T.no_content(F.col("text")))
    stats = kept.groupBy("note_id", "speaker").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return kept, stats, W.paragraphs(kept.select("note_id", "seq", "speaker", "text", "start_ms", "end_ms"), cap_ms)


def transcribed_again(new: DataFrame, old: DataFrame, gate: DataFrame, least_share: float = 0.5, quiet: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(segments, verdicts) of a new transcript: without noise, without the microphone's echoes of the system's segments, and
    without microphone segments that a gate's closed spans cover; speakers come from the old segments that they overlap; numbered
    anew by time. A note whose new transcript has less than ``least_share`` of the old one's characters is not to be committed.

    new: note_id, seq, source, text, start_ms, end_ms, lang; old: the same with speaker; gate: note_id, start_ms, end_ms.
    """
    clean = new.where(~T.is_noise(F.col("text"), F.col("end_ms") - F.col("start_ms"), F.col("lang")) & ~T.no_content(F.col("text")))
    mic, system = (clean.where(F.col("source") == s) for s in ("mic", "system"))
    echoes = J.echoes(mic, system).select("note_id", "seq").distinct()
    covered = J.coverage(mic.select("note_id", "seq", "start_ms", "end_ms"), gate).where(F.col("covered") >= quiet).select("note_id", "seq")
    kept = system.unionByName(mic.join(echoes, ["note_id", "seq"], "left_anti").join(covered, ["note_id", "seq"], "left_anti"))
    speakers = J.inherit_speakers(kept, old).select("note_id", "seq", "speaker")
    n = F.row_number().over(Window.partitionBy("note_id").orderBy("start_ms", "source", "seq")) - 1
    out = kept.join(speakers, ["note_id", "seq"], "left").withColumn("new_seq", n.cast("long")).drop("seq").withColumnRenamed("new_seq", "seq")
    size = lambda df, c: df.groupBy("note_id").agg(F.sum(F.char_length(T.effective(F.col("text")))).alias(c))
    j = size(old, "before").join(size(out, "after"), "note_id", "full").fillna(0, ["before", "after"])
    verdict = F.when(F.col("after") == 0, "empty").when(F.col("after") < least_share * F.col("before"), "too short").otherwise("commit")
    return out, j.select("note_id", "before", "after", verdict.alias("verdict"))


def rebuild_library(samples: DataFrame, make: Callable[[], Embedder], tag: str) -> DataFrame:
    """(person_id, source, vector, samples, model): every person's centroids for a new model, from all their clips. samples:
    person_id, source, clip, samples (array)."""
    v = embedded(samples.select("person_id", "source", "clip", "samples"), make).where("embedding is not null")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    unit = v.withColumn("embedding", F.transform("embedding", lambda x: x / norm)).where(norm > 0)
    each = unit.select("person_id", "source", F.posexplode("embedding").alias("i", "x")).groupBy("person_id", "source", "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return each.groupBy("person_id", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("vector"), F.max("n").alias("samples"), F.lit(tag).alias("model"))


def agent_graph(paragraphs: list[dict], entities: list[dict], relations: list[dict], version: int, contract: int, spark) -> dict:
    """An agent's entities and relations for one note, as the note's document holds them: ids, mentions and evidence offsets
    are made here, never taken from the agent. Raises ValueError with all faults if one is found.

    paragraphs: index, text; entities: kind, name, aliases; relations: subject and object (names), predicate, label,
    confidence, valid_from, valid_to, evidence (list of paragraph and quote).
    """
    if version != contract:
        raise ValueError(f"contract version {version}, not {contract}")
    schema = "relation_index int, subject string, object string, predicate string, label string, confidence double, valid_from string, valid_to string, quotes array<string>"
    rows = [(i, r.get("subject"), r.get("object"), r.get("predicate"), r.get("label"), r.get("confidence"), r.get("valid_from"), r.get("valid_to"), [e.get("quote") or "" for e in r.get("evidence") or []]) for i, r in enumerate(relations)]
    names = [(e["name"],) for e in entities if (e.get("name") or "").strip()]
    issues = L.contract_issues(spark.createDataFrame(rows, schema), spark.createDataFrame(names, "name string")).collect()
    faults = sorted((r.relation_index, r.field, r.message) for r in issues)
    texts = {p["index"]: p["text"] or "" for p in paragraphs}
    listed = [{"id": f"ent_{i + 1}", "kind": e["kind"], "name": e["name"].strip(), "aliases": sorted({a.strip() for a in e.get("aliases") or [] if a.strip()})} for i, e in enumerate(e for e in entities if (e.get("name") or "").strip())]
    by_name = {e["name"].lower(): e["id"] for e in listed}
    known = {e["id"]: [e["name"], *e["aliases"]] for e in listed}
    mentions = [{"id": f"m_{p}_{s}_{e}", "paragraph": p, "entity": k, "start": s, "end": e} for p, t in sorted(texts.items()) for k, s, e in S.mentions_of(t, known)]
    evidence, made = {}, []
    for i, r in enumerate(relations):
        ids = []
        for x in r.get("evidence") or []:
            found = S.spans_of(texts.get(x.get("paragraph"), ""), (x.get("quote") or "").strip())
            if not found:
                faults.append((i, "evidence", "quote not in its paragraph"))
                continue
            s, e = found[0]
            ident = f"ev_{x['paragraph']}_{s}_{e}"
            evidence[ident] = {"id": ident, "paragraph": x["paragraph"], "start": s, "end": e, "quote": texts[x["paragraph"]][s:e], "mentions": [m["id"] for m in mentions if m["paragraph"] == x["paragraph"] and s <= m["start"] and m["end"] <= e]}
            ids.append(ident)
        made.append({k: r.get(k) for k in ("predicate", "label", "confidence", "valid_from", "valid_to")} | {"subject": by_name.get((r.get("subject") or "").strip().lower()), "object": by_name.get((r.get("object") or "").strip().lower()), "evidence": sorted(set(ids))})
    if faults:
        raise ValueError("; ".join(f"relation {i}: {f}: {m}" for i, f, m in sorted(faults)))
    return {"contract_version": contract, "entities": listed, "mentions": mentions, "evidence": list(evidence.values()), "relations": made}


def blocks(paragraphs: list[dict], support: set[str]) -> list[dict]:
    """A document's paragraphs as an editor's blocks: runs of text and mentions, or plain text where no mention but supporting ones is left."""
    out = []
    for i, p in enumerate(paragraphs):
        live = [m for m in p.get("mentions") or [] if m.get("id") not in support]
        base = {"orig_index": i, "speaker": p.get("speaker"), "name": p.get("name"), "person_id": p.get("person_id"), "start_ms": p.get("start_ms"), "markdown": p["text"]}
        runs = S.split_runs(p["text"], [(m["start"], m["end"], m.get("id") or "") for m in live]) if live else []
        out.append(base | {"kind": "runs" if live else "markdown", "runs": runs})
    return out


def filter_people(people: DataFrame, query: str, romanised: DataFrame | None = None) -> DataFrame:
    """People whose label holds the text; Latin letters also find those whose label, written in Latin letters by ``romanised``
    (char, syllable), holds them in full or by first letters. Characters that the table lacks stay as they are."""
    q = query.strip()
    if not q:
        return people
    hit = people.where(F.contains("label", F.lit(q)))
    if romanised is None or not (q.isascii() and q.isalpha()):
        return hit
    chars = people.select("id", F.posexplode(F.filter(F.split("label", ""), lambda c: c != "")).alias("pos", "char")).join(romanised, "char", "left").withColumn("syllable", F.lower(F.coalesce("syllable", "char")))
    parts = chars.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "syllable"))).alias("x"))
    latin = parts.select("id", F.array_join(F.transform("x", lambda r: r["syllable"]), "").alias("full"), F.array_join(F.transform("x", lambda r: F.substring(r["syllable"], 1, 1)), "").alias("first"))
    more = latin.where(F.contains("full", F.lit(q.lower())) | F.contains("first", F.lit(q.lower()))).select("id")
    return people.join(hit.select("id").union(more).distinct(), "id", "left_semi")


@dataclass
class Hooks:
    """Callbacks by event. A hook that fails is noted and does not stop the others."""

    known: list[tuple[str | None, Callable[[str, dict], None]]] = field(default_factory=list)
    failed: list[tuple[str, str]] = field(default_factory=list)

    def register(self, hook: Callable[[str, dict], None], event: str | None = None) -> None:
        self.known.append((event, hook))

    def emit(self, event: str, payload: dict) -> None:
        for want, hook in self.known:
            if want in (None, event):
                try:
                    hook(event, payload)
                except Exception as e:  # a hook is somebody else's code
                    self.failed.append((event, repr(e)))

    def sink(self, event: str, column: str = "payload") -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a micro-batch's rows as events, row by row."""
        import json

        def run(batch: DataFrame, _: int) -> None:
            for r in batch.select(column).toLocalIterator():
                self.emit(event, json.loads(r[0]))

        return run
