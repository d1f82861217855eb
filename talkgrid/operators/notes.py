"""Note store: listing, visible segments, search with context, paging, durations and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions import text as T

ORDER = ("start_ms", "seq")


def time_range(notes: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Notes whose started_at lies between two texts, compared as text."""
    if low is not None:
        notes = notes.where(F.col("started_at") >= low)
    if high is not None:
        notes = notes.where(F.col("started_at") <= high)
    return notes


def listing(notes: DataFrame) -> DataFrame:
    """Newest first, ties by id; a note without a start sinks."""
    return notes.withColumn("started_at", F.coalesce("started_at", F.lit(""))).orderBy(F.desc("started_at"), F.desc("id"))


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of at most 100 rows with the total before paging."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))
    return rows.crossJoin(F.broadcast(total))  # one row


def visible(segments: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """Without suppressed and blank segments."""
    if suppressed is not None:
        segments = segments.join(suppressed.select("note_id", "seq").distinct(), ["note_id", "seq"], "left_anti")
    return segments.where(F.trim("text") != "")


def with_context(segments: DataFrame) -> DataFrame:
    """Texts of the visible neighbours, empty at the ends."""
    w = Window.partitionBy("note_id").orderBy(*ORDER)
    return segments.withColumns({"before": F.lag("text", 1, "").over(w), "after": F.lead("text", 1, "").over(w)})


def search(segments: DataFrame, needle: str) -> DataFrame:
    """Hits of a substring in either case, with context; an empty needle hits everything."""
    return with_context(visible(segments)).where(F.contains(F.lower("text"), F.lit(needle.lower())))


def durations(notes: DataFrame, segments: DataFrame) -> DataFrame:
    """Seconds up to the last segment's end; complete notes without segments have 0, others null."""
    ends = segments.groupBy(F.col("note_id").alias("id")).agg(F.max("end_ms").alias("end_ms"))
    return notes.join(ends, "id", "left").select("id", F.coalesce(F.floor(F.col("end_ms") / 1000).cast("long"), F.when(F.col("state") == "complete", F.lit(0).cast("long"))).alias("seconds"))


def export(segments: DataFrame) -> DataFrame:
    """One text a note: its visible segments as labelled lines, in order. A note's lines are gathered, as the export is one text."""
    line = F.concat(F.lit("["), T.clock(F.col("start_ms")), F.lit("] "), F.coalesce("speaker", F.lit("?")), F.lit(": "), F.col("text"), F.lit("\n"))
    rows = visible(segments).select("note_id", F.struct("start_ms", "seq", line.alias("line")).alias("x"))
    return rows.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "").alias("content"))


def purgeable(notes: DataFrame, cutoff: str | None) -> DataFrame:
    """Complete notes that ended (or started) before the cutoff, compared as text."""
    done = notes.where("state = 'complete'")
    return done if cutoff is None else done.where(F.coalesce(F.expr("nullif(ended_at, '')"), "started_at") < cutoff)


def suppress_first(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request the first segment that matches it exactly: (note_id, seq, reason). No match, no row."""
    keys = ["note_id", "speaker", "start_ms", "end_ms", "text"]
    w = Window.partitionBy(*keys).orderBy("seq")
    return segments.join(requests, keys).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("note_id", "seq", "reason")


def last_spoken(segments: DataFrame) -> DataFrame:
    """(note_id, duration_ms): where the last segment of each note ends."""
    return segments.groupBy("note_id").agg(F.max("end_ms").alias("duration_ms"))


def log_entries(log: DataFrame, kind: str | None = None, note_id=None, low: str | None = None, high: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Entries of a log (id, ts as text, kind, note_id), newest first: of one kind, one note, between two times (as text). A
    page has 1 to 500 rows."""
    for column, value in (("kind", kind), ("note_id", note_id)):
        if value is not None:
            log = log.where(F.col(column) == value)
    if low is not None:
        log = log.where(F.col("ts") >= low)
    if high is not None:
        log = log.where(F.col("ts") <= high)
    return log.orderBy(F.desc("ts"), F.desc("id")).offset(max(0, offset)).limit(min(500, max(1, limit)))


def labelled_segments(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Segments with ``label``: the speaker's name, else their number, else who speaks on the source."""
    from talkgrid.functions.rules import segment_label

    names = speakers.select("note_id", F.col("speaker_id").alias("speaker"), F.col("name").alias("_name"))
    j = segments.join(names, ["note_id", "speaker"], "left")
    return j.withColumn("label", segment_label(F.col("speaker"), F.col("source"), F.col("_name"))).drop("_name")


def numbered_titles(notes: DataFrame, taken: DataFrame) -> DataFrame:
    """Default titles of new notes (id, at), numbered from 2 where the day's title is taken: by notes of the same day that
    were there (day as yyyyMMdd, title), or by new ones before it in order of id. A number that is taken is passed over."""
    from talkgrid.functions.rules import default_title

    day = F.date_format("at", "yyyyMMdd")
    base = notes.select("id", "at", day.alias("day"), default_title(F.col("at")).alias("base"))
    number = F.when(F.col("title") == F.col("base"), 1).when(F.col("title").rlike(r" [0-9]+$"), F.regexp_extract("title", r" ([0-9]+)$", 1).try_cast("int"))
    used = taken.join(base.select("day", "base").distinct(), "day").where((F.col("title") == F.col("base")) | (F.regexp_replace("title", r" [1-9][0-9]*$", "") == F.col("base"))).withColumn("k", number)
    lists = used.where("k >= 1").groupBy("day", "base").agg(F.array_sort(F.collect_set("k")).alias("used"))
    n = F.row_number().over(Window.partitionBy("day", "base").orderBy("id"))
    j = base.withColumn("n", n).join(lists, ["day", "base"], "left").withColumn("used", F.coalesce("used", F.expr("cast(array() as array<int>)")))
    # The n-th free number: n, and one more for every taken number that is no greater than what it comes to.
    free = F.aggregate("used", F.col("n"), lambda acc, u: F.when(u <= acc, acc + 1).otherwise(acc))
    return j.select("id", F.concat("base", F.when(free > 1, F.concat(F.lit(" "), free.cast("string"))).otherwise("")).alias("title"))
