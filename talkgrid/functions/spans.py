"""Text functions that need a program: case folding, spans, mentions, redaction, file names. Arrow-batched pandas UDFs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_ENDS = [StructField("start", IntegerType()), StructField("end", IntegerType())]
SPAN = ArrayType(StructType(_ENDS))
MENTION = ArrayType(StructType([StructField("entity", StringType()), *_ENDS]))


def fold(t: str) -> str:
    """Trimmed, in full Unicode case folding."""
    return t.strip().casefold()


@pandas_udf(StringType())
def folded_key(t: pd.Series) -> pd.Series:
    return t.map(fold, na_action="ignore")


def spans_of(text: str, needle: str) -> list[tuple[int, int]]:
    """Half-open code-point spans of a needle, not overlapping; none for an empty one."""
    out, at = [], 0
    while needle and (i := text.find(needle, at)) >= 0:
        out.append((i, i + len(needle)))
        at = i + len(needle)
    return out


@pandas_udf(SPAN)
def char_spans(text: pd.Series, needle: pd.Series) -> pd.Series:
    return pd.Series([[{"start": s, "end": e} for s, e in spans_of(t or "", n or "")] for t, n in zip(text, needle, strict=True)])


def mentions_of(text: str, names: dict[str, list[str]]) -> list[tuple[str, int, int]]:
    """(entity, start, end) of names and aliases: leftmost first, then longest, then by entity; none overlap."""
    found = [(s, -(e - s), k, e) for k, all_ in names.items() for n in all_ for s, e in spans_of(text, n)]
    out, at = [], 0
    for s, _, k, e in sorted(found):
        if s >= at:
            out.append((k, s, e))
            at = e
    return out


def mention_udf(names: dict[str, list[str]]):
    """A column function over paragraphs for one document's entities."""

    @pandas_udf(MENTION)
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([[{"entity": k, "start": s, "end": e} for k, s, e in mentions_of(t or "", names)] for t in text])

    return run


def split_runs(text: str, mentions: list[tuple[int, int, str]]) -> list[tuple[str, str | None]]:
    """(text, mention id) runs; spans that are out of range, empty or overlap an earlier one are left out."""
    out, at = [], 0
    for s, e, k in sorted(mentions):
        if s < at or e <= s or e > len(text):
            continue
        if s > at:
            out.append((text[at:s], None))
        out.append((text[s:e], k))
        at = e
    if at < len(text):
        out.append((text[at:], None))
    return out


_FILE_URL = re.compile(r"file://\S+")
_WINDOWS = re.compile(r"\b[A-Za-z]:\\[^\s\"'<>|]+")
_HOME = re.compile(r"(?<![\w/])/(?:Users|home)/[^\s\"'<>|]+")
_UNIX = re.compile(r"(?<![\w/<])/(?:[\w.@+-]+/)+[\w.@+-]*")
_KEY = re.compile(r"sk-|phc_|phx_|A-SH-|[0-9a-fA-F]{32,}")
_CJK = re.compile(r"[\u4e00-\u9fff]{12,}")


def redact(t: str) -> str:
    """File URLs, Windows paths, Unix paths, key-like tokens and long CJK runs become marks, in this order."""
    t = _FILE_URL.sub("<PATH>", t)
    t = _WINDOWS.sub(lambda m: "<HOME_PATH>" if re.match(r"(?i)[a-z]:\\users\\", m.group()) else "<PATH>", t)
    t = _UNIX.sub("<PATH>", _HOME.sub("<HOME_PATH>", t))
    t = " ".join("<REDACTED>" if _KEY.search(w) else w for w in t.split())
    return _CJK.sub("<TEXT>", t)


@pandas_udf(StringType())
def redacted(t: pd.Series) -> pd.Series:
    return t.map(redact, na_action="ignore")


def cut_utf8(t: str, most: int) -> tuple[str, bool]:
    """At most so many bytes, ending on a whole character, and whether something was cut."""
    raw = t.encode("utf-8")
    return (t, False) if len(raw) <= most else (raw[:most].decode("utf-8", "ignore"), True)


_RESERVED = re.compile(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$")


def file_name(title: str, suffix: str, most: int = 160) -> str:
    """A safe file name: illegal characters and end dots go, reserved names get a mark, capped at so many bytes."""
    name = re.sub(r'[\x00-\x1f<>:"/\\|?*]', "", unicodedata.normalize("NFC", title)).strip().rstrip(".").strip()
    name = cut_utf8(name or "note", most)[0].strip()
    return f"{name}{'_' if _RESERVED.match(name) else ''}{suffix}"


@pandas_udf(StringType())
def safe_name(title: pd.Series, suffix: pd.Series) -> pd.Series:
    return pd.Series([file_name(t or "", s or "") for t, s in zip(title, suffix, strict=True)])
