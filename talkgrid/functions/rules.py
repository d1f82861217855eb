"""Small rules as Column functions: filters, validity, normal forms, labels, curves and payloads."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Back-off in ms at first and at most, and how long a stream has to live for it to begin anew.
BACK_OFF_BASE, BACK_OFF_CAP, BACK_OFF_STABLE = 1_000, 30_000, 60_000
#: Kinds of entities in the order of their colours.
KIND_ORDER = ("person", "term", "org", "project", "product", "decision", "task", "place", "date")
#: Weekdays from Monday, and names of the day's parts with the hour that each ends before; a default title is
#: made of them.
WEEKDAYS = ("一", "二", "三", "四", "五", "六", "日")
DAY_PARTS = ((5, "凌晨"), (9, "早上"), (12, "上午"), (14, "中午"), (18, "下午"), (24, "晚上"))
_TITLE = "周{}{}的会议"


def _empty(kind: str = "string") -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


# -- filters and validity ---------------------------------------------------------------------------------------------


def normalized_values(values: Column) -> Column:
    """Filter values trimmed, without empty ones, sorted, each once; null is empty."""
    kept = F.filter(F.transform(F.coalesce(values, _empty()), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(kept))


def instant(text: Column) -> Column:
    """An RFC 3339 time with its offset; null where the text is no such time."""
    shaped = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    return F.when(shaped, F.try_to_timestamp(F.upper(text)))


def bounds_verdict(low: Column, high: Column) -> Column:
    """'not a time', 'out of order' or 'ok' for two optional RFC 3339 bounds, which may be equal."""
    bad = lambda t: t.isNotNull() & instant(t).isNull()
    return F.when(bad(low) | bad(high), "not a time").when(instant(low) > instant(high), "out of order").otherwise("ok")


def checked_interval(start: Column, end: Column) -> Column:
    """A relation's interval as (from, to) times. Nulls stay; a text that is no time, or an end that is not after the
    start, is an error."""
    bad = lambda t: t.isNotNull() & instant(t).isNull()
    fail = lambda why: F.raise_error(F.concat(F.lit(why), F.coalesce(start, F.lit("")), F.lit(" "), F.coalesce(end, F.lit(""))))
    pair = F.struct(instant(start).alias("from"), instant(end).alias("to"))
    return F.when(bad(start) | bad(end), fail("not a time: ").cast("struct<from:timestamp,to:timestamp>")).when(instant(start) >= instant(end), fail("interval out of order: ").cast("struct<from:timestamp,to:timestamp>")).otherwise(pair)


def first_string(json: Column, *paths: str) -> Column:
    """The first value that JSON text has under one of the paths."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def tolerant(value: Column, condition: Column) -> Column:
    """A predicate that rejects only rows that have the field."""
    return value.isNull() | F.coalesce(condition, F.lit(False))


def speaker_passes(speaker: Column, selected: list) -> Column:
    """No selection passes all; a null speaker matches none."""
    return F.coalesce(speaker.isin(*selected), F.lit(False)) if selected else F.lit(True)


def offers_better_engine(count: Column, engine: Column, ready: Column | bool = True, least: int = 3) -> Column:
    """Enough findings, a local engine other than the best (an unknown one counts as such), and what it takes is there."""
    other = F.coalesce((engine != "firered") & ~engine.startswith("cloud:"), F.lit(True))
    return (count >= least) & other & (ready if isinstance(ready, Column) else F.lit(ready))


def since_passes(name: Column, since: str | None) -> Column:
    """Names that begin with a date from ``since`` on (compared as text over its length); names without a date pass."""
    if not since:
        return F.lit(True)
    return ~name.rlike("^[0-9]{8}") | (F.substring(name, 1, len(since)) >= since)


def valid_since(value: Column) -> Column:
    """YYYYMMDD or YYYYMMDD-HHMMSS, and a day and time that exist."""
    day = F.try_to_timestamp(F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2))).isNotNull()
    time = (F.substring(value, 10, 2) < "24") & (F.substring(value, 12, 2) < "60") & (F.substring(value, 14, 2) < "60")
    shaped = value.rlike(r"^\d{8}(-\d{6})?$")
    return F.coalesce(shaped & day & ((F.char_length(value) == 8) | time), F.lit(False))


def valid_note_id(note_id: Column) -> Column:
    """Not empty, and nothing that leads out of a folder."""
    return F.coalesce((note_id != "") & ~note_id.rlike(r"[/\\]|\.\."), F.lit(False))


def backfill_state(relations_stage: Column, version: Column, source_hash: Column, want_version: Column, want_hash: Column, entities_stage: Column, entities: Column) -> Column:
    """(current, selected): relations done under this contract and source; entities there that are not current."""
    current = F.coalesce((relations_stage == "done") & (version == want_version) & (source_hash == want_hash), F.lit(False))
    some = F.coalesce(entities_stage.isin("done", "partial") & (entities > 0), F.lit(False))
    return F.struct(current.alias("current"), (some & ~current).alias("selected"))


def canonical_set(values: Column) -> Column:
    """Whether an array is strictly rising."""
    falls = F.exists(F.sequence(F.lit(1), F.greatest(F.size(values) - 1, F.lit(1))), lambda i: F.get(values, i) <= F.get(values, i - 1))
    return ~F.coalesce(falls, F.lit(False))


# -- normal forms -----------------------------------------------------------------------------------------------------


def locale(raw: Column) -> Column:
    """A BCP 47 tag of at most 20 characters, underscores as hyphens; anything else is unknown."""
    tag = F.replace(raw, F.lit("_"), F.lit("-"))
    ok = (F.char_length(tag) <= 20) & tag.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$")
    return F.when(ok, tag).otherwise("unknown")


def os_version(raw: Column) -> Column:
    """The leading digits and dots, without dots at the ends, of at most 16 characters; else unknown."""
    v = F.regexp_replace(F.regexp_extract(F.coalesce(raw, F.lit("")), r"^[0-9.]*", 0), r"^\.+|\.+$", "")
    return F.when(v == "", "unknown").otherwise(F.substring(v, 1, 16))


def normalized_predicate(kind: Column, label: Column, core: tuple[str, ...]) -> Column:
    """(kind, label): core kinds without a label, custom with one that is not blank; null for what is neither."""
    text = F.trim(F.coalesce(label, F.lit("")))
    custom = (kind == "custom") & (text != "")
    return F.when(kind.isin(*core), F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("label"))).when(custom, F.struct(kind.alias("kind"), text.alias("label")))


def json_strings(text: Column) -> Column:
    """JSON text as an array of strings; empty where it is none."""
    return F.coalesce(F.from_json(text, "array<string>"), _empty())


def json_array(values: Column) -> Column:
    """A set as JSON text, sorted."""
    return F.to_json(F.array_sort(F.array_distinct(values)))


def speaker_names(speakers: Column) -> Column:
    """A map of speakers' records as a map of (name, person_id)."""
    return F.transform_values(speakers, lambda _, s: F.struct(s["name"].alias("name"), s["person_id"].alias("person_id")))


# -- labels -----------------------------------------------------------------------------------------------------------


def segment_label(speaker: Column, source: Column, name: Column, prefix: str = "说话人 ", me: str = "我", other: str = "对方") -> Column:
    """A speaker's name, else their number, else who speaks on that source."""
    numbered = F.concat(F.lit(prefix), F.regexp_replace(speaker, "^S+", ""))
    return F.when(speaker.isNotNull(), F.coalesce(F.when(name != "", name), numbered)).when(source == "mic", me).otherwise(other)


def relation_label(kind: Column, label: Column, core: dict[str, str]) -> Column:
    """A core predicate's label, a custom one's own, else the kind."""
    own = F.when((kind == "custom") & (F.trim(F.coalesce(label, F.lit(""))) != ""), label)
    named = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), core.items(), F.when(F.lit(False), ""))
    return F.coalesce(named, own, kind)


def default_title(at: Column) -> Column:
    """The title that a note gets from the weekday and the part of the day of its local start."""
    day = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(at) + 1)
    part = reduce(lambda c, x: c.when(F.hour(at) < x[0], x[1]), DAY_PARTS, F.when(F.lit(False), ""))
    before, middle, after = _TITLE.split("{}")
    return F.concat(F.lit(before), day, F.lit(middle), part, F.lit(after))


def is_default_title(title: Column) -> Column:
    """Whether a title is still one that was made: of weekday and part of the day, numbered or not, or the older one of
    date and time."""
    days, parts = "".join(WEEKDAYS), "|".join(p for _, p in DAY_PARTS)
    new = title.rlike(f"^{_TITLE.format(f'[{days}]', f'({parts})')}\\s*[0-9]*$")
    old = title.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2} 会议$")
    return F.coalesce(new | old, F.lit(False))


def note_badge(state: Column, paused: Column) -> Column:
    return F.when(state == "active", F.when(paused, "paused").otherwise("active")).when(state == "recording", "interrupted")


def colour_index(kind: Column, colours: int = 7, order: tuple[str, ...] = KIND_ORDER) -> Column:
    """A kind's place in the order, else the hash of its characters (times 31, 32 bits), modulo the colours."""
    place = F.array_position(F.array(*map(F.lit, order)), kind)
    points = F.transform(F.filter(F.split(kind, ""), lambda c: c != ""), lambda c: F.ascii(c))
    fold = F.aggregate(points, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))
    return (F.when(place > 0, place - 1).otherwise(fold) % colours).cast("int")


# -- times and curves -------------------------------------------------------------------------------------------------


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, 0 at least; null where either is none."""
    return F.greatest(F.lit(0).cast("long"), F.unix_timestamp(end) - F.unix_timestamp(start))


def note_window(start_ms: Column, end_ms: Column, last_ms: Column) -> Column:
    """(from, to) of a note: its end, else its start and what was said until; null if it has neither."""
    to = F.coalesce(end_ms, start_ms + last_ms)
    return F.when(start_ms.isNotNull() & (to > start_ms), F.struct(start_ms.alias("from"), to.alias("to")))


def next_back_off(before_ms: Column, lived_ms: Column) -> Column:
    """The next pause before a stream is opened again: doubled up to a cap, from the start if the stream lived long enough."""
    return F.when(lived_ms >= BACK_OFF_STABLE, F.lit(BACK_OFF_BASE)).otherwise(F.least(before_ms * 2, F.lit(BACK_OFF_CAP))).cast("long")


def hz_to_mel(f: Column) -> Column:
    return 2595.0 * F.log10(1.0 + f / 700.0)


def mel_to_hz(m: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1.0)


def bar_height(share: Column, gate: float = 0.12, gamma: float = 0.7) -> Column:
    """A level (0 to 1) as a bar: nothing up to the gate, then a power of the rest."""
    return F.pow(F.greatest(F.lit(0.0), (share - gate) / (1 - gate)), F.lit(gamma))


def tick_budget(decay: Column, least: float = 0.001) -> Column:
    """Steps until a value that loses a share of itself each step is under ``least``."""
    return F.ceil(F.lit(math.log(least)) / F.log(1 - decay)).cast("long")


# -- payloads ---------------------------------------------------------------------------------------------------------


def event_payload(name: Column, **properties: Column) -> Column:
    """A telemetry event as JSON text: its name and properties that are set."""
    return F.to_json(F.struct(name.alias("name"), *[c.alias(k) for k, c in properties.items()]))


def hook_payload(event: Column, note_id: Column, title: Column, at: Column, content: Column | None = None) -> Column:
    """What a hook is told, as JSON text; the note's content only where it is asked for."""
    note = F.struct(note_id.alias("id"), title.alias("title"), *([content.alias("content")] if content is not None else []))
    return F.to_json(F.struct(event.alias("event"), at.alias("occurred_at"), note.alias("note")))


def applying(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def record_risks(isolation: Column, bluetooth: Column) -> Column:
    """Risks of a recording, the greater loss first."""
    return applying({"voice_isolation": isolation, "bluetooth_mic": bluetooth})
