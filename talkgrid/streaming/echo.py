"""Two-source transcript stream: echo of the system's sound in the microphone is held back, dropped or retracted.

A microphone final is compared with recent system finals and otherwise held; a system final drops held microphone
segments (as residue, filler or echo) and retracts emitted ones. Holds end after a while, later while a system partial
is open. The state machine is driven by the event's own clock, so a batch run and a stream give the same rows; with
``now`` the processing time can drive the holds instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talkgrid.functions.text import ECHO_MARKS, FILLERS

HOLD_MS, HOLD_FACTOR, RETRACT_MS, RECENT_MS, NEAR_MS = 2500, 6, 30_000, 10_000, 2500
SIMILAR, CONTAINS_MIN, RESIDUE_RMS, RESIDUE_OVERLAP, FILLER_MS = 0.6, 4, 0.012, 0.8, 2500
#: No text takes part in the comparison that stands for a failed recognition.
PLACEHOLDER = "[识别失败]"
IN = "note_id long, at_ms long, kind string, source string, seq long, start_ms long, end_ms long, text string, rms double"
OUT = "note_id long, seq long, op string, reason string, at_ms long"
_MARKS = re.compile(rf"[\s{ECHO_MARKS}]")


def key(t: str) -> str:
    return _MARKS.sub("", t).lower()


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similarity(a: str, b: str) -> float:
    """As the Column function of this name, over normalised texts."""
    if not a or not b:
        return 0.0
    small, large = sorted((a, b), key=len)
    if len(small) >= CONTAINS_MIN and small in large:
        return 1.0
    return 1 - distance(a, b) / len(large)


def share(a: dict, b: dict) -> float:
    """Overlap by the length of the first."""
    n = a["end_ms"] - a["start_ms"]
    return max(0, min(a["end_ms"], b["end_ms"]) - max(a["start_ms"], b["start_ms"])) / n if n > 0 else 0.0


def near(a: dict, b: dict) -> bool:
    return (a["start_ms"] <= b["end_ms"] and b["start_ms"] <= a["end_ms"]) or abs(a["start_ms"] - b["start_ms"]) < NEAR_MS


def cjk_dominant(t: str) -> bool:
    letters = [c for c in t if c.isalnum()]
    return bool(letters) and 2 * sum("一" <= c <= "鿿" for c in letters) >= len(letters)


def echo_reason(mic: dict, system: dict) -> str | None:
    """Why a microphone segment is the system's: residue, filler or echo; None if it is not."""
    if PLACEHOLDER in (mic["text"], system["text"]):
        return None
    if mic.get("rms") is not None and mic["rms"] < RESIDUE_RMS and share(mic, system) >= RESIDUE_OVERLAP:
        return "residue"
    if mic["end_ms"] - mic["start_ms"] <= FILLER_MS and key(mic["text"]) in FILLERS and share(mic, system) >= RESIDUE_OVERLAP and cjk_dominant(system["text"]):
        return "filler"
    if near(mic, system) and similarity(key(mic["text"]), key(system["text"])) >= SIMILAR:
        return "echo"
    return None


class Dedup:
    """State of one note: recent system finals, held and emitted microphone finals, and whether a system partial is open."""

    def __init__(self, state: dict | None = None):
        s = state or {}
        self.system, self.held, self.sent, self.open = s.get("system", []), s.get("held", []), s.get("sent", []), s.get("open", False)

    def state(self) -> dict:
        return {"system": self.system, "held": self.held, "sent": self.sent, "open": self.open}

    def release(self, now: int) -> Iterator[tuple]:
        """Held segments whose time is over are emitted; what is too old to matter is forgotten."""
        wait = HOLD_MS * (HOLD_FACTOR if self.open else 1)
        due = [m for m in self.held if now - m["at_ms"] >= wait]
        self.held = [m for m in self.held if now - m["at_ms"] < wait]
        for m in due:
            self.sent.append(m)
            yield m["seq"], "emit", "released", now
        self.system = [s for s in self.system if now - s["end_ms"] <= RECENT_MS]
        self.sent = [m for m in self.sent if now - m["end_ms"] <= RETRACT_MS]

    def push(self, e: dict) -> Iterator[tuple]:
        yield from self.release(e["at_ms"])
        if e["kind"] == "partial":
            self.open = self.open or e["source"] == "system"
        elif e["kind"] == "end":
            for m in self.held:
                yield m["seq"], "emit", "flush", e["at_ms"]
            self.held = []
        elif e["source"] == "system":
            self.open = False
            self.system.append(e)
            yield e["seq"], "emit", "system", e["at_ms"]
            for pool, op in (("held", "drop"), ("sent", "retract")):
                stay = []
                for m in getattr(self, pool):
                    why = echo_reason(m, e) if op == "drop" else ("echo" if near(m, e) and PLACEHOLDER not in (m["text"], e["text"]) and similarity(key(m["text"]), key(e["text"])) >= SIMILAR else None)
                    if why:
                        yield m["seq"], op, why, e["at_ms"]
                    else:
                        stay.append(m)
                setattr(self, pool, stay)
        else:
            why = next((w for s in self.system if (w := echo_reason(e, s))), None)
            if why:
                yield e["seq"], "drop", why, e["at_ms"]
            else:
                self.held.append(e)


def _rows(note_id, got: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(note_id, *r) for r in got], columns=["note_id", "seq", "op", "reason", "at_ms"])


def _events(g: pd.DataFrame) -> list[dict]:
    rows = g.sort_values(["at_ms", "seq"], kind="stable").to_dict("records")
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return [{k: plain(v) for k, v in r.items()} for r in rows]


def dedup_batch(events: DataFrame) -> DataFrame:
    """The operation rows of whole notes; a note's events end with a flush."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        d, got = Dedup(), []
        for e in _events(g):
            got += d.push(e)
        got += d.push({"kind": "end", "at_ms": int(g["at_ms"].max()), "source": "mic"})
        return _rows(g["note_id"].iloc[0], got)

    return events.groupBy("note_id").applyInPandas(run, OUT)


def dedup_stream(events: DataFrame) -> DataFrame:
    """The same over a stream; a note's state goes with an ``end`` event. Rows are append-only operations."""

    def run(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d, got, over = Dedup(json.loads(state.get[0]) if state.exists else None), [], False
        parts = [b for b in batches if len(b)]
        for e in _events(pd.concat(parts)) if parts else ():
            got += d.push(e)
            over = over or e["kind"] == "end"
        if over:
            state.remove()
        else:
            state.update((json.dumps(d.state()),))
        yield _rows(key_[0], got)

    return events.groupBy("note_id").applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def settled(ops: DataFrame) -> DataFrame:
    """The segments that stay: emitted and not retracted later."""
    from pyspark.sql import functions as F

    last = ops.where("op in ('emit', 'retract')").groupBy("note_id", "seq").agg(F.max_by("op", F.struct("at_ms", F.when(F.col("op") == "retract", 1).otherwise(0))).alias("op"))
    return last.where("op = 'emit'").select("note_id", "seq")
