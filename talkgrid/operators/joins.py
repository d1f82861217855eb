"""Joins between notes, people, events and truth: names, votes, overlaps, calendars, candidates and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions import text as T
from talkgrid.functions import timefn as D


def display_names(speakers: DataFrame, people: DataFrame) -> DataFrame:
    """The local name if there is one, else the library's. speakers: note_id, speaker_id, name, person_id."""
    p = people.select(F.col("id").alias("person_id"), F.col("name").alias("_lib"))
    return speakers.join(p, "person_id", "left").select("note_id", "speaker_id", "person_id", F.coalesce(F.nullif("name", F.lit("")), "_lib").alias("name"))


def paragraph_speakers(paragraphs: DataFrame, segments: DataFrame) -> DataFrame:
    """Speaker of each paragraph by vote of its segments; of a tie the greatest name wins."""
    votes = paragraphs.select("note_id", "paragraph", F.explode("seqs").alias("seq")).join(segments.select("note_id", "seq", "speaker"), ["note_id", "seq"])
    n = votes.where("speaker is not null").groupBy("note_id", "paragraph", "speaker").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("note_id", "paragraph").agg(F.max_by("speaker", F.struct("n", "speaker")).alias("speaker"))


def _bucketed(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """One row for each time bucket that a row's span touches, so that range joins have an equality key."""
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end), F.col(start)) / width))))


def overlapping(a: DataFrame, b: DataFrame, width: int = 30_000) -> DataFrame:
    """Pairs of spans of one note that share time: a's columns as a_*, b's as b_*. Joined by note and time bucket; a pair
    counts in the bucket where its overlap begins."""
    left = _bucketed(a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]), "a_start_ms", "a_end_ms", width)
    right = _bucketed(b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]), "b_start_ms", "b_end_ms", width)
    both = left.join(right, (F.col("a_note_id") == F.col("b_note_id")) & (left["_bucket"] == right["_bucket"])).where("a_start_ms < b_end_ms and b_start_ms < a_end_ms")
    return both.where(F.floor(F.greatest("a_start_ms", "b_start_ms") / width) == left["_bucket"]).drop("_bucket")


def _shares(p: DataFrame) -> DataFrame:
    c = [F.col(x) for x in ("a_start_ms", "a_end_ms", "b_start_ms", "b_end_ms")]
    return p.withColumns({"shared_ms": D.overlap(*c), "share": D.overlap_share(*c)})


def inherit_speakers(new: DataFrame, old: DataFrame, least: float = 0.3) -> DataFrame:
    """(note_id, seq, speaker): of old spans that cover enough of a new one the best; same source first, then any."""
    p = _shares(overlapping(new, old)).where(F.col("share") >= least)
    w = Window.partitionBy("a_note_id", "a_seq").orderBy(F.desc(F.col("a_source") == F.col("b_source")), F.desc("share"), "b_seq")
    return p.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("a_note_id").alias("note_id"), F.col("a_seq").alias("seq"), F.col("b_speaker").alias("speaker"))


def echoes(mic: DataFrame, system: DataFrame, least: float = 0.5, alike: float = 0.75) -> DataFrame:
    """Microphone segments (note_id, seq) that a system segment covers and resembles."""
    p = _shares(overlapping(mic, system)).where(F.col("share") >= least)
    hit = p.where(T.alike(T.echo_key(F.col("a_text")), T.echo_key(F.col("b_text")), alike))
    return hit.select(F.col("a_note_id").alias("note_id"), F.col("a_seq").alias("seq")).distinct()


def coverage(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """(note_id, seq, covered): share of each segment that disjoint spans cover."""
    p = _shares(overlapping(segments, spans)).groupBy("a_note_id", "a_seq").agg(F.sum("shared_ms").alias("ms"))
    j = segments.join(p, (F.col("note_id") == F.col("a_note_id")) & (F.col("seq") == F.col("a_seq")), "left")
    return j.select("note_id", "seq", F.when(F.col("end_ms") > F.col("start_ms"), F.coalesce("ms", F.lit(0)) / (F.col("end_ms") - F.col("start_ms"))).otherwise(0.0).alias("covered"))


def purity(clusters: DataFrame, truth: DataFrame) -> DataFrame:
    """(cluster, label, share): largest share of a cluster's overlap with one truth label; ties to the smaller label."""
    p = _shares(overlapping(clusters, truth)).groupBy(F.col("a_label").alias("cluster"), F.col("b_label").alias("label")).agg(F.sum("shared_ms").alias("ms"))
    g = p.groupBy("cluster").agg(F.min_by("label", F.struct(-F.col("ms"), "label")).alias("label"), (F.max("ms") / F.sum("ms")).alias("share"))
    return g


def best_event(notes: DataFrame, events: DataFrame, tie_ms: int = 1000) -> DataFrame:
    """The event with the most time in common with a note; none if the runner-up is within the tie. All-day events don't count."""
    a = notes.select("note_id", "start_ms", "end_ms")
    p = _shares(overlapping(a, events.where(~F.col("all_day")), 6 * 3600 * 1000))
    w = Window.partitionBy("a_note_id").orderBy(F.desc("shared_ms"), "b_event_id")
    top = p.withColumns({"_n": F.row_number().over(w), "_next": F.lead("shared_ms").over(w)}).where("_n = 1")
    return top.where(F.col("_next").isNull() | (F.col("shared_ms") - F.col("_next") > tie_ms)).select(F.col("a_note_id").alias("note_id"), F.col("b_event_id").alias("event_id"))


def attendee_people(attendees: DataFrame, people: DataFrame) -> DataFrame:
    """(attendee_id, person_id): by e-mail, else by name; the smallest person of the better kind. People of one key are one row
    before they meet attendees."""
    first = lambda c: people.select(F.col("id").alias("person_id"), T.name_key(F.col(c)).alias("k")).where("k <> ''").groupBy("k").agg(F.min("person_id").alias("person_id"))
    by = lambda c, rank: attendees.select("attendee_id", T.name_key(F.col(c)).alias("k")).join(first(c), "k").select("attendee_id", F.lit(rank).alias("rank"), "person_id")
    both = by("email", 1).unionByName(by("name", 2))
    return both.groupBy("attendee_id").agg(F.min(F.struct("rank", "person_id")).alias("x")).select("attendee_id", "x.person_id")


def nearest_position(events: DataFrame, positions: DataFrame, width: int) -> DataFrame:
    """(event_id, position_id, apart): the position of the source nearest in time at any distance, the first of a tie; null
    where the source has none. Every event stays. The last position before and the first after an event are found within a
    bucket of ``width``, and beyond it from the buckets' own first and last positions; the width bounds no distance."""
    p = positions.where(F.col("source").isNotNull() & F.col("at").isNotNull()).groupBy("source", "at").agg(F.min("position_id").alias("position_id"))
    bucket = lambda c: F.floor(F.col(c) / width).alias("b")
    p = p.select("source", "at", bucket("at"), F.struct("at", "position_id").alias("p"))
    ends = p.groupBy("source", "b").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    e = events.select("source", F.col("t").alias("at"), bucket("t"), "event_id", F.lit(True).alias("event"))
    known = e.select("source", "b").distinct().join(ends, ["source", "b"], "full")
    fore, back = (Window.partitionBy("source").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("b"), F.desc("b")))
    far = known.select("source", "b", F.last("high", True).over(fore).alias("far_before"), F.last("low", True).over(back).alias("far_after"))
    both = e.unionByName(p.withColumn("event", F.lit(False)), allowMissingColumns=True)
    upto, onward = (Window.partitionBy("source", "b").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("at"), F.desc("at")))
    near = both.select("*", F.max("p").over(upto).alias("before"), F.min("p").over(onward).alias("after")).where("event")
    j = near.join(far, ["source", "b"], "left").select("event_id", "at", F.coalesce("before", "far_before").alias("x"), F.coalesce("after", "far_after").alias("y"))
    pick = lambda c: F.when(F.col(c).isNotNull() & F.col("at").isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{c}.at")).alias("apart"), F.col(f"{c}.at").alias("at"), F.col(f"{c}.position_id").alias("position_id")))
    return j.select("event_id", F.least(pick("x"), pick("y")).alias("z")).select("event_id", "z.position_id", "z.apart")


def outcomes(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """(key, outcome): correct, wrong or missing."""
    return truth.join(predicted, key, "left").select(key, F.when(F.col("got").isNull(), "missing").when(F.col("got") == F.col("want"), "correct").otherwise("wrong").alias("outcome"))


def tidy_queue(groups: list[tuple[str, DataFrame]], dismissed: DataFrame) -> DataFrame:
    """Groups of items (id) in the order given, without what was dismissed: group_rank, kind, id."""
    out = None
    for rank, (kind, df) in enumerate(groups):
        part = df.select(F.lit(rank).alias("group_rank"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out.join(dismissed.select("kind", "id"), ["kind", "id"], "left_anti").select("group_rank", "kind", "id")


def candidates(per_cluster: DataFrame, recent: DataFrame, adopted: DataFrame, k: int = 5, n_recent: int = 10, cap: int = 30) -> DataFrame:
    """(rank, person_id): the best of each cluster, then the most recent, then adopted ones; first mention counts, capped."""
    w = Window.partitionBy("cluster").orderBy(F.desc("sim"), "person_id")
    a = per_cluster.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("person_id", F.struct(F.lit(0).alias("g"), F.col("cluster").cast("long").alias("o"), F.col("n").cast("long").alias("n")).alias("at"))
    b = recent.orderBy(F.desc("seen"), "person_id").limit(n_recent).select("person_id", F.struct(F.lit(1).alias("g"), (-F.col("seen")).cast("long").alias("o"), F.lit(0).cast("long").alias("n")).alias("at"))
    c = adopted.select("person_id", F.struct(F.lit(2).alias("g"), F.col("person_id").cast("long").alias("o"), F.lit(0).cast("long").alias("n")).alias("at"))
    first = a.unionByName(b).unionByName(c).groupBy("person_id").agg(F.min("at").alias("at"))
    return first.orderBy("at", "person_id").limit(cap).select("person_id", "at")


def first_seen_entities(rows: DataFrame) -> DataFrame:
    """Entities of a document folded by name, in first-seen order: note_id, entity (ent_1, ...), name, aliases (sorted)."""
    k = T.name_key(F.col("name"))
    g = rows.where(F.trim("name") != "").groupBy("note_id", k.alias("k")).agg(F.min(F.struct("pos", "name")).alias("x"), F.array_sort(F.collect_set("alias")).alias("aliases"))
    n = F.row_number().over(Window.partitionBy("note_id").orderBy("x.pos", "k"))
    return g.select("note_id", F.concat(F.lit("ent_"), n.cast("string")).alias("entity"), F.col("x.name").alias("name"), "aliases")
