"""Queries of the note store."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.functions import rules as R
from talkgrid.functions import text as T
from talkgrid.functions import timefn as D
from talkgrid.operators import notes as N
from talkgrid.operators import people as P
from talkgrid.plans import views as V
from talkgrid.plans.registry import query

_EMPTY_SUPPRESSED = "(SELECT conv_id AS note_id, turn AS seq FROM conversations WHERE turn % 7 = 3)"


@query(f"WITH {V.NOTES} SELECT id, started_at, state FROM notes ORDER BY started_at DESC, id DESC")
def note_listing(spark, d):
    """S01"""
    return N.listing(V.notes(spark, d))


@query(f"WITH {V.NOTES} SELECT id, started_at FROM notes WHERE started_at >= '1995-01-01' AND started_at <= '1996-12-31'")
def note_time_range(spark, d):
    """bounds compare as text, so a bare date excludes its own day's times."""
    return N.time_range(V.notes(spark, d), "1995-01-01", "1996-12-31").select("id", "started_at")


@query(f"WITH {V.NOTES} SELECT id, started_at, (SELECT count(*) FROM notes) AS total FROM notes ORDER BY started_at DESC, id DESC LIMIT 50 OFFSET 100")
def note_page(spark, d):
    """O01"""
    return N.page(V.notes(spark, d), [F.desc("started_at"), F.desc("id")], 100, 50).select("id", "started_at", "total")


@query(f"WITH {V.SEG} SELECT note_id, seq, speaker, text, start_ms, end_ms FROM seg WHERE (note_id, seq) NOT IN {_EMPTY_SUPPRESSED} AND trim(text) <> ''")
def visible_segments(spark, d):
    """Every seventh turn stands for the suppressed ones."""
    s = V.segments(spark, d)
    return N.visible(s, s.where("seq % 7 = 3"))


@query(f"""WITH {V.SEG}, vis AS (SELECT * FROM seg WHERE trim(text) <> ''),
ctx AS (SELECT note_id, seq, text, lag(text, 1, '') OVER w AS before, lead(text, 1, '') OVER w AS after FROM vis WINDOW w AS (PARTITION BY note_id ORDER BY start_ms, seq))
SELECT * FROM ctx WHERE contains(lower(text), 'the')""")
def note_search(spark, d):
    """F02, W01"""
    return N.search(V.segments(spark, d), "The").select("note_id", "seq", "text", "before", "after")


@query(f"""WITH {V.SEG} SELECT DISTINCT note_id FROM seg WHERE trim(text) <> '' AND contains(lower(text), 'the') ORDER BY note_id LIMIT 100""")
def note_search_first_notes(spark, d):
    """The first hundred notes with a hit."""
    return N.search(V.segments(spark, d), "the").select("note_id").distinct().orderBy("note_id").limit(100)


@query(f"WITH {V.SEG} SELECT note_id, max(end_ms) AS duration_ms FROM seg GROUP BY 1")
def note_duration(spark, d):
    """A04"""
    return N.last_spoken(V.segments(spark, d))


@query(f"""WITH {V.SEG}, {V.NOTES}, n AS (SELECT id, CASE WHEN state = 'F' THEN 'complete' ELSE 'recording' END AS state FROM notes)
SELECT n.id, coalesce(CAST(floor(e.m / 1000) AS BIGINT), CASE WHEN state = 'complete' THEN 0 END) AS seconds FROM n LEFT JOIN (SELECT note_id, max(end_ms) AS m FROM seg GROUP BY 1) e ON n.id = e.note_id""")
def note_seconds(spark, d):
    """A05"""
    n = V.notes(spark, d).withColumn("state", F.when(F.col("state") == "F", "complete").otherwise("recording"))
    return N.durations(n, V.segments(spark, d))


@query(f"""WITH {V.SEG} SELECT note_id, string_agg('[' || printf('%02d:%02d:%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || '] ' || coalesce(speaker, '?') || ': ' || text || chr(10), '' ORDER BY start_ms, seq) AS content
FROM seg WHERE trim(text) <> '' GROUP BY 1""")
def note_export(spark, d):
    """K06, X24"""
    return N.export(V.segments(spark, d))


@query(f"""WITH {V.NOTES} SELECT id FROM notes WHERE state = 'F' AND started_at < '1996-01-01'""")
def purgeable_notes(spark, d):
    """S19"""
    n = V.notes(spark, d).withColumns({"state": F.when(F.col("state") == "F", "complete").otherwise("recording"), "ended_at": F.lit("")})
    return N.purgeable(n, "1996-01-01").select("id")


@query(f"WITH {V.SEG} SELECT note_id, min(seq) AS seq, 'echo' AS reason FROM seg WHERE seq % 5 = 2 GROUP BY note_id, speaker, start_ms, end_ms, text")
def suppression_append(spark, d):
    """Of equal segments the first is suppressed."""
    s = V.segments(spark, d)
    ask = s.where("seq % 5 = 2").select("note_id", "speaker", "start_ms", "end_ms", "text").distinct().withColumn("reason", F.lit("echo"))
    return N.suppress_first(s, ask)


@query(f"WITH {V.NOTES} SELECT id, CASE WHEN d < 300 THEN '<5m' WHEN d < 1800 THEN '5-30m' WHEN d < 3600 THEN '30-60m' ELSE '>1h' END AS bucket, CASE WHEN d >= 3600 THEN printf('%dh%dm', d // 3600, d % 3600 // 60) WHEN d >= 60 THEN printf('%dm%ds', d // 60, d % 60) ELSE printf('%ds', d) END AS label FROM (SELECT id, id * 37 % 5000 AS d FROM notes)")
def duration_labels(spark, d):
    """D04, X25"""
    s = (F.col("id") * 37 % 5000).cast("long")
    return V.notes(spark, d).select("id", D.duration_bucket(s).alias("bucket"), T.human_duration(s).alias("label"))


@query('SELECT c_custkey AS person_id, count(o_orderkey) AS segments, count(DISTINCT o_orderkey) AS notes FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1')
def speaker_list(spark, d):
    """Customers are people, orders are where they appear."""
    people = V.table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"))
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("note_id"))
    return P.speaker_list(people, o)


@query("SELECT conv_id AS note_id, turn AS seq, CASE WHEN turn % 5 <> 0 AND role IS NOT NULL THEN CASE WHEN role = 'user' THEN 'Ann' ELSE '说话人 ' || role END WHEN turn % 2 = 0 THEN '我' ELSE '对方' END AS label FROM conversations")
def segment_labels(spark, d):
    """Users have a name, systems none, and missing speakers go by source."""
    s = V.segments(spark, d).withColumns({"source": F.when(F.col("seq") % 2 == 0, "mic").otherwise("system"), "speaker": F.when(F.col("seq") % 5 != 0, F.concat(F.lit("S"), "speaker"))})
    names = s.where("speaker is not null").select("note_id", F.col("speaker").alias("speaker_id")).distinct().withColumn("name", F.when(F.col("speaker_id") == "Suser", "Ann").otherwise(""))
    return N.labelled_segments(s, names).select("note_id", "seq", "label")


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type AS kind, user_id AS note_id FROM events WHERE event_type = 'click' AND strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024' ORDER BY 2 DESC, 1 DESC LIMIT 500")
def log_filter(spark, d):
    """newest 500 of a kind, bounds as text."""
    e = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_type").alias("kind"), F.col("user_id").alias("note_id"))
    return N.log_entries(e, kind="click", low="2024", limit=9000)
