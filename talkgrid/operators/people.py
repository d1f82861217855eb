"""Speakers of notes and people of the library: merging, syncing, repair, counts and review lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.operators.graph import follow_redirects


def speaker_list(people: DataFrame, appearances: DataFrame) -> DataFrame:
    """People with their segments and notes, the most spoken first; those who never appear have 0.

    people: person_id and others; appearances: person_id, note_id (one row a segment).
    """
    per = appearances.groupBy("person_id").agg(F.count(F.lit(1)).alias("segments"), F.countDistinct("note_id").alias("notes"))
    return people.join(per, "person_id", "left").fillna(0, ["segments", "notes"]).orderBy(F.desc("segments"), "person_id")


def notes_of_people(appearances: DataFrame, redirects: DataFrame) -> DataFrame:
    """(person_id, notes): notes of each person after redirects; ids that lead nowhere stay as they are.

    appearances: note_id, person_id; redirects: old_id, new_id.
    """
    ids = appearances.select(F.col("person_id").alias("id")).distinct()
    at = follow_redirects(ids, redirects).select(F.col("id").alias("person_id"), F.coalesce("target", "id").alias("canonical"))
    return appearances.join(at, "person_id").groupBy(F.col("canonical").alias("person_id")).agg(F.countDistinct("note_id").alias("notes"))


def without_samples(people: DataFrame, samples: DataFrame) -> DataFrame:
    """People of whom there is no sample; redirects are not followed."""
    return people.join(samples.select("person_id"), "person_id", "left_anti")


def merge_speakers(speakers: DataFrame, merges: DataFrame) -> DataFrame:
    """Speakers after live merges: a loser's row goes into its winner's, whose name and person stay unless they are blank;
    sources are united and counts added. Several losers of one winner fill in by their ids' order.

    speakers: note_id, speaker_id, name, person_id, sources (array), count; merges: note_id, loser, winner.
    """
    to = merges.select("note_id", F.col("loser").alias("speaker_id"), "winner")
    j = speakers.join(to, ["note_id", "speaker_id"], "left").withColumns({"_into": F.coalesce("winner", "speaker_id"), "_lost": F.col("winner").isNotNull()})
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    first = lambda c: F.min_by(blank(c), F.when(blank(c).isNotNull(), F.struct("_lost", "speaker_id")))
    g = j.groupBy("note_id", F.col("_into").alias("speaker_id")).agg(F.coalesce(first("name"), F.lit("")).alias("name"), first("person_id").alias("person_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.sum("count").alias("count"))
    return g


def sync_speakers(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Add-only: speakers seen are added, names and counts that are there stay, sources are united.

    known: note_id, speaker_id, name, sources, count; seen: note_id, speaker_id, sources, count.
    """
    s = seen.select("note_id", "speaker_id", F.col("sources").alias("_sources"), F.col("count").alias("_count"))
    none = F.expr("cast(array() as array<string>)")
    j = known.join(s, ["note_id", "speaker_id"], "full")
    return j.select("note_id", "speaker_id", F.coalesce("name", F.lit("")).alias("name"), F.array_sort(F.array_union(F.coalesce("sources", none), F.coalesce("_sources", none))).alias("sources"), F.greatest(F.coalesce("count", F.lit(0)), F.coalesce("_count", F.lit(0))).alias("count"))


def snapshot(speakers: DataFrame) -> DataFrame:
    """What live clustering starts from: each speaker's id, name and number of segments; blank names are none."""
    return speakers.select("note_id", "speaker_id", F.when(F.trim("name") != "", F.col("name")).alias("name"), "count")


def mixed_ids(speakers: DataFrame) -> DataFrame:
    """(note_id, speaker_id) of speakers flagged as several people."""
    return speakers.where(F.coalesce("multi_speaker", F.lit(False))).select("note_id", "speaker_id")


def repair_orphans(segments: DataFrame, speakers: DataFrame, merges: DataFrame, hops: int = 8) -> tuple[DataFrame, DataFrame]:
    """Segments whose speaker is missing follow the note's merges (loser, winner) to one that is there; ids that lead to
    none get an empty entry. (segments with ``repaired``, entries to add). Null speakers stay null."""
    key = lambda c: F.concat_ws("\u0000", F.col("note_id").cast("string"), c)
    ids = segments.where("speaker is not null").select("note_id", "speaker").distinct().select("note_id", "speaker", key("speaker").alias("id"))
    there = speakers.select(key("speaker_id").alias("k"), F.col("speaker_id").alias("_live")).distinct()
    lost = ids.join(there, F.col("id") == F.col("k"), "left_anti")
    ends = follow_redirects(lost.select("id"), merges.select(key("loser").alias("old_id"), key("winner").alias("new_id")), hops)
    found = lost.join(ends, "id").join(there, F.col("target") == F.col("k"), "left").select("note_id", "speaker", F.col("_live").alias("_to"))
    j = segments.join(found.withColumn("_lost", F.lit(True)), ["note_id", "speaker"], "left")
    out = j.withColumns({"repaired": F.coalesce("_lost", F.lit(False)), "speaker": F.coalesce("_to", "speaker")}).drop("_to", "_lost")
    return out, found.where("_to is null").select("note_id", F.col("speaker").alias("speaker_id")).distinct()


def chunk_outcomes(chunks: DataFrame) -> DataFrame:
    """(note_id, outcome, failed): done, done with relation errors, partial with the failed chunks, or failed where every
    chunk failed by the network.

    chunks: note_id, chunk, error (null, 'network' or 'content'), relation_error (boolean).
    """
    g = chunks.groupBy("note_id").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad"), F.count_if(F.col("error") == "network").alias("net"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("chunk")))).alias("failed"), F.bool_or(F.coalesce("relation_error", F.lit(False))).alias("rel"))
    outcome = F.when(F.col("net") == F.col("n"), "failed").when(F.col("bad") > 0, "partial").when(F.col("rel"), "done with relation errors").otherwise("done")
    return g.select("note_id", outcome.alias("outcome"), "failed")


def index_remap(kept: DataFrame, key: str, old: str) -> DataFrame:
    """``new_index`` (from 0) of what is kept, by its old order."""
    return kept.withColumn("new_index", F.row_number().over(Window.partitionBy(key).orderBy(old)).cast("long") - 1)


def review_split(items: DataFrame, invalid: Column) -> DataFrame:
    """``archived``: review items whose receipt no longer holds."""
    return items.withColumn("archived", F.coalesce(invalid, F.lit(False)))


def override_targets(items: DataFrame, overrides: DataFrame, people: DataFrame) -> DataFrame:
    """``target`` of each item: the override's if that person still exists, else its own. items: id, target; overrides: id, target."""
    live = people.select(F.col("id").alias("_o")).distinct()
    o = overrides.select("id", F.col("target").alias("_o")).join(live, "_o", "left_semi")
    return items.join(o, "id", "left").withColumn("target", F.coalesce("_o", "target")).drop("_o")


def without_support(mentions: DataFrame, support: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct mentions that are no supporting ones."""
    return mentions.select(*keys).join(support.select(*keys), keys, "left_anti").distinct()


def split_preview(selected: DataFrame, key: str) -> DataFrame:
    """(key, notes, mentions, relations) of selected mentions: distinct notes, mentions and relations. selected: key,
    note_id, mention_id, relation_ids (array)."""
    rel = selected.select(key, F.explode("relation_ids").alias("r")).groupBy(key).agg(F.countDistinct("r").alias("relations"))
    g = selected.groupBy(key).agg(F.countDistinct("note_id").alias("notes"), F.countDistinct("mention_id").alias("mentions"))
    return g.join(rel, key, "left").fillna(0, ["relations"])


def resolvable_mentions(lists: DataFrame, entities: DataFrame) -> DataFrame:
    """Each mention of a note's array of (k, id) with whether its entity is known. lists: note_id, m."""
    known = entities.select("id", F.lit(True).alias("_ok")).distinct()
    each = lists.select("note_id", F.explode("m").alias("m")).select("note_id", "m.k", "m.id")
    return each.join(known, "id", "left").select("note_id", "k", F.coalesce("_ok", F.lit(False)).alias("resolvable"))


def new_events(events: DataFrame, seen: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """Of events with equal keys the first, and none whose keys are in the snapshot. Null keys are equal to each other."""
    first = events.groupBy(*keys).agg(F.min_by(F.struct(*events.columns), order).alias("_x")).select("_x.*")
    if seen is None:
        return first
    s = seen.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        here = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = here if on is None else on & here
    return first.join(s, on, "left_anti")


def drift_report(sources: DataFrame, rate: float = 200.0, reanchors: int = 3, burst: float = 6.0) -> DataFrame:
    """One row a session: its anomalies in order of the rules, and the two sources' relative rate where both converged.

    sources: session, source ('mic' or 'system'), rate_ppm, quality, reanchors, burst_per_min, converged.
    """
    from talkgrid.functions.rules import applying

    rules = applying({"rate_ppm_high": F.abs("rate_ppm") > rate, "quality_degraded": F.col("quality") == "degraded", "reanchors_high": F.col("reanchors") > reanchors, "declared_rate_untrusted": F.col("burst_per_min") >= burst})
    g = sources.withColumn("_a", F.transform(rules, lambda k: F.concat_ws(":", "source", k))).groupBy("session").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("source", "_a"))), lambda x: x["_a"])).alias("anomalies"),
        *[F.max(F.when((F.col("source") == s) & F.col("converged"), F.col("rate_ppm"))).alias(f"_{s}") for s in ("mic", "system")],
    )
    return g.select("session", "anomalies", (F.col("_mic") - F.col("_system")).alias("rel_ppm"))


def drift_distribution(reports: DataFrame, key: str = "device") -> DataFrame:
    """(key, sessions, degraded, reanchors, worst): sessions by device. reports: key, degraded (boolean), reanchors, rate_ppm."""
    return reports.groupBy(key).agg(F.count(F.lit(1)).alias("sessions"), F.count_if("degraded").alias("degraded"), F.sum("reanchors").alias("reanchors"), F.max(F.abs("rate_ppm")).alias("worst"))
